"""Names, extraction by publisher, generic cards, sinks, imports and intake on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunks, editorial, intake, keeping, ledger, libraries, search
from inkwell.sources import digests, scans


def test_directory_names():
    assert keeping.directory(7, "Ｈｅｌｌｏ，　Wörld™ 2") == "007-hello-wörldtm-2"
    assert keeping.directory(1234, "\x00\x1f !?") == "1234-untitled" and keeping.directory(0, None) == "000-untitled"
    assert keeping.directory(1, "汉" * 200) == "001-" + "汉" * 96
    assert keeping.directory(1, "a" * 95 + " b") == "001-" + "a" * 95


LONG = "<p>" + "word " * 80 + "</p>"


@pytest.mark.parametrize(
    ("publisher", "html", "method"),
    [
        ("BCG", f"<main><div data-component='article-body'>{LONG}</div><p>x</p></main>", "selector:[data-component=article-body]"),
        ("Anthropic", f"<div id='main-content'>{LONG}</div>", "selector:#main-content"),
        ("McKinsey", f"<div class='x article-body y'>{LONG}</div>", "selector:.article-body"),
        ("MIT", f"<main role='main'>{LONG}</main>", "selector:main[role=main]"),
        ("Other", f"<article>{LONG}</article>", "selector:article"),
        ("Bain", f"<article>{LONG}</article>", "readability"),
        ("Other", "<div>no paragraph</div>", "none"),
    ],
)
def test_articles_are_where_their_publishers_put_them(publisher, html, method):
    found = digests.extracted(html, "https://x.example/a/", publisher)
    assert found["method"] == method and found["status"] == ("thin" if method == "none" else "extracted")


def test_extraction_cleans_and_counts():
    page = (
        "<head><title>T</title><meta property='og:title' content='Og'><meta name='author' content=' Me '></head><main><article><h1>Head</h1><nav>menu</nav><div class='Newsletter-box'>news</div><div id='cookieBar'>c</div>"
        f"<p aria-hidden='true'>hidden</p><p>see <a href='../r'>this</a> and <b>bold</b> <img src='p.png' alt='pic'></p>{LONG}<ul><li>one</li></ul><time datetime='2026-08-01'>x</time></article></main>"
    )
    found = digests.extracted(page, "https://x.example/a/b", "BCG")
    assert (found["title"], found["byline"], found["published_at"]) == ("Head", "Me", "2026-08-01")
    assert (found["heading_count"], found["paragraph_count"]) == (1, 2)
    assert found["markdown"].startswith("# Head\n\nsee [this](https://x.example/r) and **bold** ![pic](https://x.example/a/p.png)\n\nword")
    assert not any(x in found["markdown"] for x in ("menu", "news", "hidden", "cookie"))
    assert digests.extracted("", "", "")["status"] == "thin"


def test_generic_cards_of_any_layout():
    page = (
        "<body class='core'><article class='article-card x' id='e1' data-score='9' data-priority='Track'><h2>原题</h2><div class='translated-title'>译题</div><div class='evidence'>Proof <span class='locator'>p. 3</span></div><time datetime='2026-01-02'></time>"
        "<a href='https://a.example'>a</a><a href='http://b.example'>b</a></article><article class='other'><h3>no</h3></article><article class='analysis-card'><h3>H</h3><span class='original-title'>O</span><p class='score'>High 85/100</p></article>"
    )
    one, two = digests.generic_cards(page)
    assert (one["id"], one["title_original"], one["title_zh"], one["score"], one["priority"], one["source_url"], one["published_at"]) == ("e1", "原题", "译题", 9, "track", "https://a.example", "2026-01-02")
    assert (one["evidence"], one["locator"]) == ("Proof p. 3", "p. 3")
    assert (two["id"], two["title_original"], two["title_zh"], two["score"], two["source_url"]) == (None, "O", "H", 85, None)
    assert digests.generic_cards("") == []


def test_sinks_write_what_is_read_again(spark, tmp_path):
    articles = spark.createDataFrame([("a", "T", "core", "# H\n\nbody"), ("b", "U", "", "")], "id string, title string, core_view string, content string")
    corpus = chunks.nested(chunks.chunk(articles, "id", "content"), articles.drop("content"))
    totals = chunks.write_corpus(corpus, str(tmp_path / "corpus"), str(tmp_path / "browser")).first()
    assert (totals.articles, totals.chunks) == (2, 1)
    light = {r["id"]: r for r in map(json.loads, (x.value for x in spark.read.text(str(tmp_path / "browser")).collect()))}
    assert light["a"]["summary"] == "core" and light["a"]["chunk_count"] == 1 and light["b"]["summary"] == "" and light["b"]["chunk_count"] == 0
    readers = editorial.rendered(articles, "content")
    assert {(r.id, r.violation) for r in keeping.write_readers(readers, str(tmp_path / "readers"), editorial.reader_violations).collect()} == {("b", "empty")}
    keeping.write_state(articles, articles.agg(F.count("*").alias("n")), str(tmp_path / "state"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "state/summary")).collect()] == [{"n": 2}]
    stored = keeping.write_archive(articles, str(tmp_path / "archive"))
    assert sorted(r.id for r in stored.collect()) == ["a", "b"] and stored.columns == articles.columns
    digests.write_lines(articles, str(tmp_path / "lines"))
    assert {json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "lines")).collect()} == {"a", "b"}


def test_writing_twice_keeps_translations(spark):
    old = spark.createDataFrame([("a", "s", "t\n", "译"), ("b", "s", "t\n", None)], "id string, snapshot string, source string, translation string")
    new = spark.createDataFrame([("a", "S", " T "), ("c", "S", "T")], "id string, snapshot string, source string")
    once = keeping.written(old, new)
    twice = keeping.written(once.drop("snapshot_sha256", "source_sha256"), new)
    rows = sorted(map(tuple, once.collect()))
    assert rows == sorted(map(tuple, twice.collect()))
    assert [r[:4] for r in rows] == [("a", "S", "T\n", "译"), ("b", "s", "t\n", ""), ("c", "S", "T\n", "")]


def test_files_beside_records(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.md").write_text("x")
    (tmp_path / "b" / "r.pdf").write_bytes(b"1234")
    files = scans.listing(spark, str(tmp_path))
    assert sorted((r.name, r.size) for r in files.collect()) == [("r.pdf", 4), ("x.md", 1), ("x.md", 1)]
    rows = files.where("name = 'x.md'").select("folder")
    assert sorted(bool(r.pdf) for r in scans.with_file(rows, files, "r.pdf", "pdf").collect()) == [False, True]


def test_union_scan_fails_on_a_repeat(spark):
    one = spark.createDataFrame([("1", "https://x.example/a?utm_source=z")], "id string, source_url string")
    two = spark.createDataFrame([("2", "https://x.example/b", "more")], "id string, source_url string, extra string")
    assert ledger.union_scan(one, two).count() == 2
    with pytest.raises(ValueError, match="repeated url"):
        ledger.union_scan(one, spark.createDataFrame([("3", "https://x.example/a#top")], "id string, source_url string"))
    with pytest.raises(ValueError, match="repeated id"):
        ledger.union_scan(one, one)


def test_merge_keeps_rows_without_identity(spark):
    a = spark.createDataFrame([("1", "https://x.example/a", 1)], "id string, url string, ordinal int")
    b = spark.createDataFrame([("2", None, 2), ("3", None, 3), (None, "https://x.example/c", 4), (None, "https://x.example/d", 5), ("4", "https://x.example/e", 6), ("4", "https://x.example/f", 7), ("5", "https://x.example/E/", 8)], "id string, url string, ordinal int")
    assert sorted(r.ordinal for r in ledger.merge(a, b).collect()) == [1, 2, 3, 4, 5, 6]


def test_refresh_problems_can_fail_a_job(spark):
    candidates = spark.createDataFrame([(1, "https://x.example/a", "BCG", "included", None, None), (2, "https://x.example/A/", "BCG", "included", None, None)], "candidate_id int, url string, publisher string, status string, reason string, published_at string")
    seen = spark.createDataFrame([("https://x.example/a#x", "verified", "Study")], "url string, inspected string, inspected_title string")
    titles = spark.createDataFrame([("https://X.example/a", "题", None)], "url string, title_zh string, title_original string")
    old = spark.createDataFrame([("bcg-refresh-a", "BCG", None, 4, 1), ("bcg-refresh-a-2", "BCG", None, None, 2), ("bcg-refresh-a-1", "BCG", None, 1, 3)], "id string, publisher string, url string, archive_index int, ordinal int")
    found = intake.problems(candidates, seen, titles, old)
    assert [(r.candidate_id, r.problem) for r in found.collect()] == [(2, "known url")]
    with pytest.raises(ValueError, match="known url: https://x.example/A/"):
        intake.required(found)
    (row,) = intake.records(candidates, seen, titles, old).collect()
    assert (row.id, row.title_original, row.archive_index, row.confidence, row.radar_title) == ("bcg-refresh-a-3", "Study", 6, "high", intake.RADARS["BCG"])


def test_chunk_search_caps_articles(spark):
    rows = spark.createDataFrame([("a", "t", "p", None, None, None, "# H\n\n" + "\n\n# S\n\n".join(["alpha beta"] * 6)), ("b", "t", "p", None, None, None, "alpha and more"), *[(f"c{i}", "t", "p", None, None, None, "gamma delta") for i in range(20)]], "id string, title string, publisher string, category string, priority string, published_at string, content string")
    found = search.search_chunks(search.chunk_rows(rows), ["alpha"]).collect()
    assert sorted(r.chunk_id for r in found) == ["a:001", "a:002", "a:003", "b:001"] and [r.rank for r in sorted(found, key=lambda r: r.rank)] == [1, 2, 3, 4]


def test_unknown_orders_fail(spark):
    with pytest.raises(ValueError):
        libraries.ordered(spark.range(1), "size")


def test_ledgers_are_written_by_library(spark, tmp_path):
    sources = spark.createDataFrame([("l", "s1", "t", "p", None, "研究", "https://x.example", "f", "p. 1", "lim")], "library string, source_id string, title string, publisher string, published_at string, evidence_type string, url string, fact string, locator string, limitation string")
    cases = "array<struct<company:string,summary:string,source_id:string,case_type:string,caveat:string,market:string,basis:string>>"
    scenarios = spark.createDataFrame(
        [("l", "l-01", "t", "P0", True, 1, ["s1"], [("s1", "f", "p. 1")], [("c", "s", "s1", "k", "v", "中国", "b")], ("high", "r"), "current")],
        f"library string, id string, title string, priority string, matrix_eligible boolean, matrix_rank int, evidence_ids array<string>, source_facts array<struct<source_id:string,text:string,locator:string>>, company_cases {cases}, confidence struct<level:string,reason:string>, evidence_window string",
    )
    libraries.write_ledgers(scenarios, sources, str(tmp_path))
    (row,) = spark.read.text(f"{tmp_path}/scenarios/library=l").collect()
    assert json.loads(row.value)["company_cases"] == [{"company": "c", "source_id": "s1", "market": "中国", "caveat": "v"}]
    assert json.loads(spark.read.text(f"{tmp_path}/evidence/library=l").first().value)["source_id"] == "s1"


def test_digests_of_another_title_or_count_fail(spark):
    from inkwell.sources import adapters

    page = "<title>D</title><article class='article-card' id='a'><h3>T</h3><div class='score'>Low · 3/10</div></article>"
    rows = lambda title, expected: spark.createDataFrame([("d", page, "bcg", "P", title, expected)], "digest string, html string, adapter string, publisher string, title string, expected int")
    (row,) = adapters.scan(rows("D", 1)).collect()
    assert (row.id, row.score, row.tier, row.category, row.confidence, row.source_url, row.canonical_url) == ("p-a", 3.0, "low", "uncategorized", "unknown", None, None)
    for title, expected in (("E", 1), ("D", 2)):
        with pytest.raises(Exception, match="title D is not E|expected 2 records, found 1"):
            adapters.scan(rows(title, expected)).collect()
    assert adapters.scan(rows(None, None)).count() == 1
    with pytest.raises(ValueError, match="unknown adapter"):
        adapters.records(page, "other", "P")
