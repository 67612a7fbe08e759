"""Density scoring against an independent plain version, and by cases."""

import random
import re
import xml.etree.ElementTree as ET

import duckdb
import pytest

from inkwell.plans import registry
from inkwell.sources import density, digests

PROSE = "Some words of prose, with commas, that go on and on for quite a while until they end. "


def page(body):
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def found(body):
    parts = density.article(digests.tree(page(body)))
    return [density.spoken(p) for p in parts]


def test_the_element_around_the_paragraphs_is_taken():
    menu = "<div><ul>" + "".join(f'<li><a href="/{i}">a menu entry of many words, {i}</a></li>' for i in range(30)) + "</ul></div>"
    story = "<div>" + f"<p>{PROSE * 3}</p>" * 4 + "</div>"
    assert found(menu + story) == [(PROSE * 12).strip()]
    # Beside it: prose, and what holds enough points; not a list of links, nor a label.
    beside = f"<div class='x'>label</div><p>{PROSE}</p>{story}<div>{menu}</div><div>{f'<p>{PROSE * 2}</p>' * 3}</div>"
    got = found(f"<div>{beside}</div>")
    assert len(got) == 3 and got[0] == PROSE.strip() and got[2] == (PROSE * 6).strip()


def test_names_speak_for_and_against():
    one, two = f"<p>{PROSE * 4}</p>", f"<p>{PROSE * 4}</p><p>{PROSE}</p>"
    assert found(f"<div class='story-text'>{one}</div><div class='promo'><div>{two}</div></div>")[0] == (PROSE * 4).strip()
    # What its names rule out is looked at only where nothing else is enough.
    assert found(f"<div class='sidebar'>{two * 3}</div><div>{one * 2}</div>") == [(PROSE * 8).strip()]
    assert found(f"<div class='sidebar'>{two * 3}</div><p>Too short.</p>")[0].startswith(PROSE.strip())


@pytest.mark.parametrize("body", ["", "plain text without any element", "<p>short</p>", "<div>" * 3000 + "x" + "</div>" * 3000, "<ul>" + '<li><a href="/x">y</a></li>' * 50 + "</ul>"])
def test_pages_without_paragraphs(body):
    assert found(body) in ([], [body]) or len(body) > 300


def test_open_paragraphs_and_items_end_where_the_next_begins():
    root = digests.tree("<div><p>one<p>two<b>bold<p>three<ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table></div>")
    div = root.children[0]
    assert [n.tag for n in div.children] == ["p", "p", "p", "ul", "table"]
    assert [n.tag for n in div.children[3].children] == ["li", "li"]
    assert [[c.tag for c in n.children] for n in div.children[4].children] == [["td", "td"], ["td"]]
    deep = digests.tree("<p>x" * 5000)
    assert len(deep.children) == 5000


def test_an_article_of_short_paragraphs_only_is_whole():
    # As its lines are all too short to count, what the names rule out was the only paragraph.
    ad, lines = f'<div class="ad">{PROSE}</div>', [f"Line {i} of many." for i in range(60)]
    for body in ("<div>" + "".join(f"<p>{x}</p>" for x in lines) + "</div>", "".join(f"<p><b>{x}<br>" for x in lines)):
        assert found(ad + body) == ["".join(lines)]
        got = digests.extracted(page(f"<nav>menu</nav>{ad}{body}<footer>end</footer>"), "", "")
        assert (got["status"], got["method"], got["character_count"], got["paragraph_count"]) == ("extracted", "readability", len("".join(lines)), 60)
        assert got["markdown"].count("\n\n") == 59 and all(x in got["markdown"] for x in lines)
    assert found(f"{ad}<p>Too short.</p>")[0].startswith(PROSE.strip())


def plain_points(root):
    """Points by element, each summed over all paragraphs below it, from their definition."""
    parent = {c: p for p in root.iter() for c in p}
    text = lambda e: re.sub(r"\s+", " ", "".join(e.itertext())).strip()
    blocks = set("blockquote dl div img ol p pre table ul h1 h2 h3 h4 h5 h6 section article main".split())

    def above(e):
        out = []
        while e in parent:
            e = parent[e]
            out.append(e)
        return out

    gone = lambda e: e.get("class") == "sidebar"
    paragraphs = [e for e in root.iter() if e in parent and (e.tag in ("p", "td", "pre", "section", "h2") or e.tag == "div" and not any(d.tag in blocks for d in list(e.iter())[1:])) and len(text(e)) >= 25 and not any(gone(x) for x in [e, *above(e)])]
    out = {}
    for e in root.iter():
        below = [(above(p).index(e), p) for p in paragraphs if e in above(p)[:5]]
        if not below or e.tag == "html":
            continue
        base = {"div": 5, "td": 3, "blockquote": 3, "ul": -3, "li": -3}.get(e.tag, 0) + {"content": 25, "promo": -25}.get(e.get("class"), 0)
        share = {0: 1, 1: 1 / 2, 2: 1 / 6, 3: 1 / 9, 4: 1 / 12}
        total = base + sum(share[level] * (2 + text(p).count(",") + min(3, int(len(text(p)) / 100))) for level, p in below)
        links = sum(len(text(a)) * (0.3 if a.get("href").startswith("#") else 1) for a in e.iter("a")) / max(len(text(e)), 1)
        out[e.get("n")] = round(total * (1 - links), 9)
    return out


def random_page(rng, numbers, depth=0):
    tag = rng.choice(["div", "div", "section", "p", "ul", "td", "blockquote", "span"]) if depth else "body"
    name = rng.choice(["", "", "", ' class="content"', ' class="promo"', ' class="sidebar"']) if depth else ""
    words = lambda: " ".join(rng.choice(["word,", "and", "longer", "text"]) for _ in range(rng.randint(0, 40)))
    link = lambda: f'<a n="{next(numbers)}" href="{rng.choice(["#x", "/y"])}">{words()}</a>' if rng.random() < 0.4 else ""
    inner = "".join(random_page(rng, numbers, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 and tag not in ("p", "span") else ""
    return f'<{tag} n="{next(numbers)}"{name}>{words()} {link()}{inner}</{tag}>'


def test_points_equal_a_plain_version():
    some = 0
    for seed in range(300):
        rng = random.Random(seed)
        source = f'<html n="h">{random_page(rng, iter(range(10_000)))}</html>'
        # As XML, without the ends that HTML implies.
        def build(e, parent=None):
            node = digests.Node(e.tag, dict(e.attrib), parent)
            node.children = [x for x in [e.text] if x]
            for c in e:
                node.children += [build(c, node), *([c.tail] if c.tail else [])]
            return node

        tree = ET.fromstring(source)
        got = {n.attrs["n"]: round(p, 9) for n, p in density.points(build(tree))}
        assert got == plain_points(tree)
        some += len(got)
    assert some > 300


def test_references_of_cut_headings_are_those_of_the_sql(spark, tmp_path):
    whole = "a &amp; b &quot;c&quot; &lt;d&gt; &#39;e&#39; &copy; f&amp;lt;g &QUOT; &notit;"
    heads = [*(whole[:i] for i in range(1, len(whole) + 1)), "at last &quot", "at last &quot and more", "&lt", "&ampere", "&#39 &#x27; &#3"]
    pages = [(i, f"https://x.example/{i}", f"<html><body><nav>&copy;</nav><article><h1>{h}</h1><p>{PROSE * 6}&quot;{h}</p></article></body></html>") for i, h in enumerate(heads)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["density_extracts"](spark, str(tmp_path)).select("page_id", "enough", "method", "characters", "title")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, enough, method, characters, title FROM ({registry.ORACLES['density_extracts']}) ORDER BY page_id").fetchall()
    assert sorted(map(tuple, got.collect())) == want
    # The operator reads what HTML does.
    assert digests.extracted(f"<h1>at last &quot</h1><p>{PROSE * 6}</p>", "", "")["title"] == 'at last "'
