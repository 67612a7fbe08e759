import random

import pytest

from inkwell.llm import pages

MENU = "<nav><ul><li><a href='/'>Home</a></li></ul></nav><header class='site'><h1>Site</h1></header>"


def text(html):
    return " ".join(pages.content(html)[0])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple\n\n text", "plain & simple text"),
        (f"<body>{MENU}<article><h1>A&nbsp;b</h1><p>one <b>t</b>wo<br>three<p>four</article><footer>f</footer>", "A b one two three four"),
        ("<article><p>x</p><div class='ad'>buy<div>more</div></div><p>y</p></article>", "x y"),
        ("<article><p class='ad'>buy<p>kept</article>", "kept"),
        ("<main><p>a</p><aside>side</aside><form>f<input></form><p>b</p></main><div>outside</div>", "a b"),
        ("<article><script>var t='</p>';</script><style>p{}</style>x<!-- <p>no</p> -->y</article>", "xy"),
        ("<article>a<section id='comments'><article class='comment'>rude</article></section>b</article>", "a b"),
        ("<article><header><h1>Title</h1><span>by me</span></header>body</article>", "Title body"),
        ("<article>1 < 2 and <i class=x>3</i> > 2</article>", "1 < 2 and 3 > 2"),
        ("<article>cut <b>off <p>end", "cut off end"),
        ("<div role='main'>m</div><div class='cookie-notice'>c</div><div hidden>h</div>", "m"),
        ("<body><div class='pageHeader'>h</div><p>t</p><div style='display: none'>z</div></body>", "t"),
        ("<article><table><tr><td>a<td>b<tr><td>c</table></article>", "a b c"),
    ],
)
def test_content(html, want):
    assert text(html) == want


def test_shared_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        found = sorted(pages.shared(a, b))
        assert len(found) == table[-1][-1]
        at = 0
        for i in found:
            at = b.index(a[i], at) + 1


def brute(data):
    """The contract on a list of (page_id, url, html): nearest page of the host in order, shared lines go."""
    keyed = []
    for i, (page_id, url, html) in enumerate(data):
        rest = (url or "").split("//", 1)[-1] if "//" in (url or "") else (url or "")
        host, _, path = rest.partition("/") if "//" in (url or "") else ("", "", rest)
        found, doubtful = pages.content(html)
        keyed.append({"i": i, "host": host.lower(), "path": ("/" if "//" in (url or "") and "/" in rest else "") + path, "page_id": page_id, "all": found, "doubt": doubtful})
    answers = {}
    for x in keyed:
        answers.setdefault((x["host"], x["path"], x["page_id"], *x["all"]), []).append(x["i"])
    keyed = [x for x in keyed if x["i"] in {same[0] for same in answers.values()}]
    keyed.sort(key=lambda x: (x["host"], x["path"], x["page_id"] is not None, x["page_id"]))
    out = {}
    for n, page in enumerate(keyed):
        gone = set(pages.template(page, keyed[max(0, n - 1) : n] + keyed[n + 1 : n + 2]))
        out[page["i"]] = " ".join(t for k, (t, d) in enumerate(zip(page["all"], page["doubt"], strict=True)) if not (d and k in gone))
    return {i: out[same[0]] for same in answers.values() for i in same}


@pytest.mark.parametrize("partitions", ["1", "8", "40"])
def test_extract_equals_brute_force(spark, partitions):
    rng = random.Random(7)
    data = []
    for i in range(60):
        host = rng.choice(["a.example", "hot.example", "hot.example"])
        template = f"<div>Welcome to {host}</div><div>All rights</div>"
        body = "".join(f"<p>{rng.choice(['common line', f'own {i} {k}', f'more {rng.random()}'])}</p>" for k in range(rng.randint(1, 6)))
        page = f"<html><body>{template}<article>{body}</article></body>" if i % 4 == 0 else f"<html><body>{template}{body}<div>Bye</div></body>"
        data.append((i, f"http://{host}/p/{rng.randint(1, 40)}/{i}", page))
    data += [(60, None, None), (61, "", ""), (None, "x", "<p>t</p>"), (63, "http://a.example", "<p>root</p>"), data[5]]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.createDataFrame([(*r, "clash", 1) for r in data], "page_id long, url string, html string, text string, h long").repartition(5)
        got = sorted((str(r.page_id), str(r.url), r.text) for r in pages.extract(rows).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    want = brute(data)
    assert got == sorted((str(r[0]), str(r[1]), want[i]) for i, r in enumerate(data))
    assert not any("Welcome" in r[2] and r[0] == "3" for r in got)


def test_extract_of_an_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
