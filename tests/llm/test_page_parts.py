"""Main parts, names of elements, very long pages, and extraction against a reference of its own."""

import random
import re
from os.path import commonprefix

import pytest

from inkwell.llm import pages


def text(html):
    return " ".join(pages.content(html)[0])


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<main><p>body</p><article>teaser</article></main>", "body teaser"),
        ("<main><h1>Title</h1><article>text</article></main><article>below</article><p>out</p>", "Title text below"),
        ("<article>a<div class='search-results'>b</div><div class='form-factor'>c</div><p id='related-work'>d</p></article>", "a b c d"),
        ("<article>a<div class='comment-list'>x</div><div class='cookie_banner'>x</div><div class='relatedPosts'>x</div><div class='wide share-buttons'>x</div>b</article>", "a b"),
        ("<article>a<div class='user-comments'>x</div><section id='article-comments'>x</section><div class='reader-comments'>x</div><div class='article-share'>x</div><div class='inline-ad-unit'>x</div>b</article>", "a b"),
        ("<div class='search-results'>found</div><div class='site-search'>x</div>", "found"),
        ("<section class='form-factor'>a</section><div class='market-share'>b</div><div class='search-form'>x</div><div class='cookie-policy-x'>x</div>", "a b"),
        ("<div>by</div><h1 itemprop='headline'>T</h1><div itemprop='articleBody'>b<p class='ad'>c</p></div><div>x</div>", "T b"),
        ("<div role='article'>a</div><div>x</div>", "a"),
        ("<div class='site-footer'>x</div><div class='top-nav-primary'>x</div><p>t</p>", "t"),
        ("<article><p>é&eacute;&#233;&#xE9; &lt;b&gt;</p></article>", "éééé <b>"),
        (f"<article>{'<p>long line</p>' * 30_000}</article>", " ".join(["long line"] * 30_000)),
        ("<div>" * 5_000 + "deep" + "</div>" * 5_000, "deep"),
    ],
)
def test_main_parts(html, want):
    assert text(html) == want


def lcs(a, b):
    """Indexes of ``a`` in one longest common subsequence: its length by the table alone."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def parts(html):
    """Lines of the pages made below: articles, mains and plain divisions, by the letter of the markup."""
    out = []
    for tag, body in re.findall(r"<(article|main|div|nav)>(.*?)</\1>", html):
        out += [(tag, re.sub(r"<[^>]+>", "", x)) for x in re.findall(r"<p>(.*?)</p>", body)]
    return [x for x in out if x[0] != "nav"]


@pytest.mark.parametrize("partitions", ["1", "12"])
def test_extraction_by_an_independent_reference(spark, partitions):
    """Own lines are distinct, template lines stand once and in one order: every longest alignment is the same."""
    rng = random.Random(11)
    data = []
    for i in range(90):
        host = rng.choice(["a.example", "b.example", "c.example"])
        shared = [f"{host} {x}" for x in ("welcome", "notice", "terms", "bye") if rng.random() < 0.8]
        own = [f"page {i} line {k}" for k in range(rng.randint(0, 4))]
        kind = rng.choice(["article", "main", "div", "div"])
        quote = "" if kind == "div" else "<p>quote</p>"
        head = "".join(f"<p>{x}</p>" for x in shared[:2])
        tail = "".join(f"<p>{x}</p>" for x in shared[2:])
        body = "".join(f"<p>{x}</p>" for x in own)
        data.append((i, f"http://{host}/p/{i:03d}", f"<nav><p>menu</p></nav><div>{head}</div><{kind}>{body}{quote}</{kind}><div>{tail}</div>"))
    seen = {}
    for i, url, html in data:
        found = parts(html)
        main = [x for x in found if x[0] != "div"]
        seen[i] = (url.split("/")[2], url, [x for _, x in (main or found)], bool(main))
    want, removed = {}, 0
    for i, (host, url, mine, vouched) in seen.items():
        near = max(((len(commonprefix([url, u])), j < i, -abs(i - j), lines) for j, (h, u, lines, _) in seen.items() if h == host and lines != mine), default=None)
        gone = set() if vouched or near is None else {x for x in mine if x in near[3]}
        assert vouched or near is None or lcs(mine, near[3]) == len(gone)
        want[i] = " ".join(x for x in mine if x not in gone)
        removed += len(gone)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert got == want
    assert removed > 40


def test_alignment_of_long_pages_of_repeated_lines(monkeypatch):
    """Lines that repeat add nothing to the time, and halves meet as the whole does."""
    import time

    began = time.perf_counter()
    n = 8000
    assert len(pages.shared([9, *[1, 2] * (n // 2), 8], [*[2, 1] * (n // 2), 7])) == n - 1
    assert time.perf_counter() - began < 6
    rng = random.Random(3)
    for limit in (1, 40, 1 << 26):
        monkeypatch.setattr(pages, "TABLE", limit)
        for _ in range(150):
            a, b = ([rng.randint(0, rng.choice([1, 6, 30])) for _ in range(rng.randint(0, 40))] for _ in range(2))
            found = sorted(pages.shared(a, b))
            assert len(found) == lcs(a, b)
            at = 0
            for i in found:
                at = b.index(a[i], at) + 1


def test_lines_of_a_very_long_open_page(spark):
    """A page of 40 000 lines without an article, next to one that shares every second line."""
    mine = "".join(f"<div>{'shared' if i % 2 else 'own'} {i}</div>" for i in range(40_000))
    other = "".join(f"<div>shared {i}</div>" for i in range(1, 40_000, 2))
    rows = [(1, "http://a.example/x/1", mine), (2, "http://a.example/x/2", other)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: " ".join(f"own {i}" for i in range(0, 40_000, 2)), 2: ""}
