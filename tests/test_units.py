"""Single operators on literal cases."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.functions import markdown, scores, text, urls
from inkwell.operators import archive, browse, chunks, decisions, editorial, ledger, search
from inkwell.sources import digests, scans
from inkwell.streaming import runs


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first().x


# chunks


def test_heading_stack_compresses_skipped_levels():
    got = [c[1] for c in chunks.chunked("intro\n# A\na\n### B\nb\n### C\nc\n## D\nd\n# E\n")]
    assert got == ["正文", "A", "A › B", "A › B › C", "A › D"]


@pytest.mark.parametrize("seed", range(6))
def test_chunks_cover_the_text_and_overlap(seed):
    rng = random.Random(seed)
    body = "".join(rng.choice(["word ", "end. ", "句。", "\n\n", "x"]) for _ in range(900)).strip()
    parts = list(chunks.pieces(body, 200, 30))
    assert all(len(p) <= 201 for p in parts)
    at = 0
    for p in parts:
        at = body.index(p, max(0, at - 260))
        at += len(p)
    assert "".join(body.split()).endswith("".join(parts[-1].split()))


def test_split_is_lossless_and_keeps_atoms():
    source = "p1\n\n" + "a" * 95 + " https://example.com/long/path?x=1 12,345.6% " + "b" * 200 + "\n\nlast"
    parts = chunks.packed(source, 100)
    assert "".join("".join(parts).split()) == "".join(source.split())
    assert any("https://example.com/long/path?x=1" in p for p in parts) and any("12,345.6%" in p for p in parts)
    assert [len(p) for p in chunks.packed("z" * 251, 100)] == [100, 100, 51]
    assert chunks.packed("", 10) == [] and chunks.packed(None) == []


def test_chunk_rows_of_null_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "x")], "id long, text string")
    assert [tuple(r) for r in chunks.chunk(docs, "id", "text").select("id", "chunk_no", "content").collect()] == [(None, 1, "x")]


# Markdown


def test_blocks_know_fences_lists_and_tables():
    source = "# T\n\n```\n# no\n```\n\n- a\n  more\n- b\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\n> q\n\n    code\n\npara\nline"
    assert [b.kind for b in markdown.blocks(source)] == ["heading", "code", "list", "table", "quote", "code", "paragraph"]


def test_noise_needs_whole_blocks_of_one_class():
    assert markdown.noise("Share\nPrint") == "save_share_print"
    assert markdown.noise("Share\nHome") is None and markdown.noise("Share this report") is None and markdown.noise("- Share") is None
    assert markdown.noise("[Print](https://x.example/print)") == "save_share_print" and markdown.noise("[Print](https://x.example/report)") is None
    body, gone = markdown.cleaned("Intro\n\nShare\nPrint\n\n```\nShare\n```\n\nEnd")
    assert [g[1] for g in gone] == ["save_share_print"] and body == "Intro\n\n```\nShare\n```\n\nEnd"


def test_facts_take_touching_then_nearest_qualifiers():
    assert [(n, q) for n, q, _, _ in markdown.facts("成本为 US$5 million，增长 12%。")] == [("5", "currency:USD+scale:million"), ("12", "rate:percent")]
    assert [(n, q) for n, q, _, _ in markdown.facts("The share in percent was 40 in all")] == [("40", "rate:percent")]
    assert [(n, q) for n, q, _, _ in markdown.facts("percent" + " " * 40 + "40")] == [("40", "")]
    assert markdown.facts("`5%`") == []


def test_drift_names_what_is_lost():
    assert markdown.drift("## A\n\n5 km", "A\n\n5 kg") == [("missing_fact", "5|unit:km", 1), ("missing_heading", "h2", 1)]
    assert markdown.drift("# A", "# A") == []
    assert ("length", "0.50", 1) in markdown.polished("", "abcd", "ab")


def test_alignment_tells_which_item_is_missing():
    assert markdown.aligned(["a", "b", "c"], ["a", "c"], lambda x, y: float(x != y)) == [1]
    assert markdown.aligned([], ["a"], lambda x, y: 0.0) == []


def test_rendering_escapes_and_drops_unsafe_links():
    out = markdown.rendered("# A & B\n\n**b** *e* `x<y` [ok](https://x.example) [bad](javascript:alert(1)) ![pic](p.png)\n\n1. one\n2. two\n\n| h |\n|---|\n| c |")
    assert "<h1>A &amp; B</h1>" in out and "<code>x&lt;y</code>" in out and 'href="https://x.example"' in out and "javascript" not in out.replace("alert", "")
    assert "<ol><li>one</li><li>two</li></ol>" in out and "<td>c</td>" in out and "图：pic" in out
    assert markdown.rendered(None) == ""


def test_reader_violations(spark):
    rows = spark.createDataFrame([(1, "<p>x</p>"), (2, " "), (3, "<script>x</script>"), (4, '<p onclick="x">'), (5, '<a href="x">')], "id int, html string")
    assert {(r.id, r.violation) for r in editorial.reader_violations(rows).collect()} == {(2, "empty"), (3, "unsafe tag"), (4, "unsafe attribute"), (5, "links out of balance")}


# functions


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/a/b/?utm_source=x&q=1&FBCLID=2#top", "https://example.com/a/b?q=1"),
        ("https://example.com", "https://example.com/"),
        ("https://example.com/", "https://example.com/"),
        ("https://example.com/x?gclid=1", "https://example.com/x"),
    ],
)
def test_canonical_urls(spark, url, want):
    assert one(spark, urls.canonical(F.col("u")), u=url) == want


def test_slugs_and_hosts(spark):
    assert one(spark, urls.slug(F.col("u")), u="https://x.example/a/Big News!.html") == "big-news-html"
    assert one(spark, urls.slug(F.col("u")), u="https://x.example/") == "article"
    assert one(spark, urls.allowed(F.col("u"), F.array(F.lit("x.example"))), u="https://www.x.example/p") is True
    assert one(spark, urls.allowed(F.col("u"), F.array(F.lit("x.example"))), u="https://notx.example/p") is False


def test_scores(spark):
    assert [one(spark, scores.normalized(F.col("t"), F.col("s")), t=t, s=s) for t, s in ((9.2, 10.0), (3.0, 4.0), (8.65, 10.0))] == [92.0, 75.0, 86.5]
    assert one(spark, scores.normalized(F.lit(None).cast("double"), F.lit(10.0))) is None and one(spark, scores.normalized(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, scores.strict_date(F.col("d")), d="2026-02-30") is False and one(spark, scores.strict_date(F.col("d")), d="2026-02-28") is True
    assert one(spark, scores.labelled_dimensions(F.col("x")), x="CV 30/35 IB 20/25 SR 21/25 ES 12/15").asDict() == {"content": 30, "impact": 20, "relevance": 21, "evidence": 12}
    assert one(spark, scores.labelled_dimensions(F.col("x")), x="CV 30") is None
    assert one(spark, scores.ordered_dimensions(F.col("x")), x="30/35 20/25 21 / 25 12/15").evidence == 12
    assert one(spark, scores.confidence_label(F.col("x")), x="Confidence: Medium") == "middle"


def test_text(spark):
    assert one(spark, text.tokens(F.col("x")), x="AI-driven 企业治理 5.2 人") == ["ai-driven", "5.2", "企业", "业治", "治理", "人"]
    assert one(spark, text.clean(F.col("x")), x=" a b \n c ") == "a b c"
    assert one(spark, text.paragraph_count(F.col("x")), x="# h\n\na\n\n\n b \n\n## i") == 2
    assert one(spark, text.source_language(F.col("x")), x="中文中文 ab") == "zh"
    assert one(spark, text.label_distance(F.lit(""), F.lit(""))) == 0.0


def test_unknown_sort_mode_fails(spark):
    with pytest.raises(ValueError):
        browse.ordered(spark.range(1), "size")


def test_empty_query_finds_nothing(spark):
    docs = spark.createDataFrame([("a", "p", None, None, None, "x y")], "id string, publisher string, category string, priority string, published_at string, search_text string")
    assert search.search(docs, []).count() == 0
    assert search.search(docs, ["x"], {"date_from": "2027-01-01"}).count() in (0, 1)


# ledger and archive


def test_strict_merge_fails_on_the_first_repeat(spark):
    a = spark.createDataFrame([("1", "https://x.example/a", 1)], "id string, url string, ordinal int")
    b = spark.createDataFrame([("2", "https://x.example/a/", 2)], "id string, url string, ordinal int")
    with pytest.raises(ValueError, match="url"):
        ledger.merge(a, b, strict=True)
    assert ledger.merge(a, b).count() == 1


def test_batches(spark):
    rows = spark.createDataFrame([("a1", "p", 1, 60), ("a2", "p", 2, 40), ("a3", "p", 3, 500), ("a4", "p", 4, 1), ("b1", "q", 1, 10)], "id string, publisher string, archive_index int, source_characters int")
    assert {r.id: (r.publisher, r.batch) for r in archive.batches(rows, 2, 100).collect()} == {"a1": ("p", 1), "a2": ("p", 1), "a3": ("p", 2), "a4": ("p", 3), "b1": ("q", 1)}


def test_manifest_file_quotes_everything(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'say "x"', None), (1, "a,b", "z")], "archive_index int, title string, note string")
    archive.write_manifest(rows, f"file://{tmp_path}/m", ["archive_index", "title", "note"], "archive_index")
    lines = [x for f in sorted((tmp_path / "m").glob("part-*")) for x in f.read_text().splitlines() if not x.startswith('"archive_index"')]
    assert lines == ['"1","a,b","z"', '"2","say ""x""",""']


def test_empty_decision_tables(spark):
    sources = spark.createDataFrame([], "source_id long, publisher string, published_at string, url string")
    assert decisions.source_violations(sources).count() == 0


# sources


def test_metadata_ledger_and_sidecar_scans(spark, tmp_path):
    for i in (1, 2):
        folder = tmp_path / f"a/{i}"
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text(json.dumps({"id": "same", "n": i}, indent=1))
    (tmp_path / "a/1/translation.md").write_text("你好\n世界")
    found = scans.metadata(spark, f"file://{tmp_path}/a", "id string, n int")
    assert found.count() == 2 and [r.n for r in scans.latest(found).collect()] == [2]
    assert [r.body for r in scans.sidecars(spark, f"file://{tmp_path}/a", "translation.md").collect()] == ["你好\n世界"]
    (tmp_path / "l1.json").write_text('[{"id": "x"}]')
    (tmp_path / "l2.json").write_text(' {"articles": [{"id": "y"}, {"id": "z"}]}')
    assert [r.id for r in scans.ledger_file(spark, f"file://{tmp_path}/l1.json", "id:string").collect()] == ["x"]
    assert [r.id for r in scans.ledger_file(spark, f"file://{tmp_path}/l2.json", "id:string").collect()] == ["y", "z"]


def test_search_dump_and_captions(spark):
    raw = "First title (https://x.example/1)\nmeta\nmeta\nbody one\nbody two\nSecond (https://x.example/2)\nother"
    got = one(spark, scans.search_block(F.col("r")), r=raw)
    assert (got.title, got.url, got.body) == ("First title", "https://x.example/1", "body one\nbody two")
    assert one(spark, scans.transcript(F.col("v")), v="WEBVTT\n\n1\n00:00.000 --> 00:01.000\n<b>Hi</b> &amp; you\n\n2\n00:01.000 --> 00:02.000\nHi &amp; you\nbye") == "Hi & you\n\nbye"


CARD = "<html><body><article class='article-card' id='article-7' data-priority='Must read' data-categories='a|b'><h3>T</h3><h4>x</h4><section><h4>核心观点</h4><p>Core</p></section><p class='score'>High · 9/10</p><div class='date'>2026-07-01</div><footer><a href='http://x'>h</a><a href='https://x.example/7'>s</a></footer></article></body></html>"


def test_digest_cards(spark):
    (row,) = digests.cards(CARD, "outline")
    assert (row["id"], row["title_original"], row["score"], row["core_zh"], row["source_url"], row["published_at"]) == ("article-7", "T", "9", "Core", "https://x.example/7", "2026-07-01")
    rows = spark.createDataFrame([("d", "outline", CARD)], "digest string, layout string, html string")
    assert digests.scan(rows, {"d": 1}).count() == 1
    with pytest.raises(Exception, match="expected 2"):
        digests.scan(rows, {"d": 2}).count()


def test_article_extraction():
    body = "word " * 80
    got = digests.article(f"<nav>menu</nav><main><article><h1>Head</h1><p>{body}<a href='/x'>link</a></p><div class='ad'><p>buy</p></div></article></main><footer>f</footer>", "https://x.example/a/b")
    assert got["status"] == "extracted" and got["title"] == "Head" and "[link](https://x.example/x)" in got["markdown"] and not re.search("menu|buy", got["markdown"])
    assert digests.article("<p>short</p>", "")["status"] == "thin"


# streams


def test_event_lines_survive_malformed_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text('{"type": "status", "stage": "retrieving"}\n\nnot json\n{"type": "done"}\n')
    stream = runs.event_stream(spark, f"file://{tmp_path}/in")
    runs.write_events(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    kinds = [json.loads(x)["type"] for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert kinds == ["status", "error", "done"]
    runs.write_events(runs.event_stream(spark, f"file://{tmp_path}/in"), f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert sum(len(f.read_text().splitlines()) for f in (tmp_path / "out").glob("part-*")) == 3


def test_glossaries_of_all_shapes():
    from inkwell.operators import dialogue

    want = {"智能体": ["agent"]}
    assert dialogue.glossary({"agent": "智能体"}) == want
    assert dialogue.glossary({"智能体": ["agent"]}) == want
    assert dialogue.glossary({"x": {"preferred": "智能体", "prohibited": ["agent"]}}) == want
    assert dialogue.glossary([{"term": "x", "translation": "智能体", "forbidden": "agent"}]) == want
    assert dialogue.glossary(None) == {} and dialogue.glossary({"x": 3}) == {}


def test_fetching_retries_only_what_may_pass():
    from inkwell.sources import fetch

    waits = []

    def server(*answers):
        left = list(answers)

        def get(url, timeout):
            answer = left.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer, url, "text/html", "<p>x</p>"

        return get

    assert fetch.page("u", server(503, OSError("reset"), 200), sleep=waits.append)["attempts"] == 3 and waits == [0.5, 1.0]
    assert fetch.page("u", server(404), sleep=waits.append)["status"] == "failed"
    assert fetch.page("u", server(403), sleep=waits.append)["status"] == "blocked"
    lost = fetch.page("u", server(*[OSError("down")] * 4), sleep=waits.append)
    assert (lost["status"], lost["attempts"], lost["error"]) == ("failed", 4, "down")


def test_fetching_a_table(spark):
    from inkwell.sources import fetch

    def get(url, timeout):
        return (200 if url.endswith("1") else 404), url, "text/html", "body"

    rows = fetch.pages(spark.createDataFrame([("a1",), ("b2",)], "url string"), get, sleep=lambda s: None).collect()
    assert {r.url: (r.status, r.body) for r in rows} == {"a1": ("downloaded", "body"), "b2": ("failed", None)}
    with pytest.raises(ValueError):
        fetch.pages(spark.range(1), get, concurrency=13)
