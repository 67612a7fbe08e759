"""Translation, chunk, browse, decision, source and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores, text
from inkwell.operators import browse, chunks, decisions, translation
from inkwell.plans import bindings as b
from inkwell.sources import scans


def _markdown(spark, sf):
    """documents as Markdown: a title, and a heading of level 2 or 3 before every fourth line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 == 3, F.concat(F.when(i % 8 == 3, "## ").otherwise("### "), F.substring(x, 1, 30), F.lit("\n\n"), x)).otherwise(x))
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", F.concat(F.lit("# "), "source", F.lit("\n\n"), F.array_join(lines, "\n\n")).alias("markdown"))


def _plain(spark, sf):
    return b.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _wide(rows):
    return rows.withColumn("missing_urls", F.size("missing_urls")).withColumn("missing_numbers", F.size("missing_numbers")).withColumn("errors", F.array_join("errors", ",")).withColumn("han_ratio", F.round("han_ratio", 6))


_URLS = r"""list_transform(regexp_extract_all({c}, 'https?://[^\s)>\]"'']+'), lambda u: regexp_replace(u, '[.,;:!?]+$', ''))"""
_NUMS = r"list_transform(regexp_extract_all({c}, '\d+(?:[.,]\d+)*[%‰]?'), lambda u: regexp_replace(u, '[%‰]$', ''))"


def _missing(expr):
    s, t = expr.replace("{c}", "source"), expr.replace("{c}", "translation")
    return f"len(list_filter(list_distinct({s}), lambda v: len(list_filter({t}, lambda x: x = v)) < len(list_filter({s}, lambda x: x = v))))"


def _paragraphs(col):
    return rf"len(list_filter(list_transform(regexp_split_to_array({col}, '\n\n+'), lambda p: trim(p, E' \t\n\r')), lambda p: p <> '' AND NOT regexp_matches(p, '^#{{1,6}}\s')))"


def _headings(col):
    return rf"len(regexp_extract_all({col}, '(?m)^#{{1,6}}\s+\S'))"


_VERIFIED = rf"""{b.PAIRS},
    m AS (SELECT id, {_headings('source')}::INT AS source_headings, {_headings('translation')}::INT AS headings, {_missing(_URLS)}::INT AS missing_urls, {_missing(_NUMS)}::INT AS missing_numbers,
                 {_paragraphs('source')}::INT AS source_paragraphs, {_paragraphs('translation')}::INT AS paragraphs,
                 coalesce(len(regexp_extract_all(translation, '\p{{Han}}')) / nullif(len(regexp_extract_all(translation, '[\p{{L}}\p{{N}}]')), 0), 0)::DOUBLE AS han, length(source)::INT AS source_length, length(translation)::INT AS length FROM pairs),
    verified AS (SELECT m.* EXCLUDE (han), round(han, 6) AS han_ratio, list_filter([CASE WHEN headings < source_headings THEN 'headings' END, CASE WHEN missing_urls > 0 THEN 'urls' END, CASE WHEN missing_numbers > 0 THEN 'numbers' END,
                 CASE WHEN paragraphs < greatest(1, floor(source_paragraphs * 0.8::DOUBLE)) THEN 'paragraphs' END, CASE WHEN han < 0.12 THEN 'language' END], lambda x: x IS NOT NULL) AS e, length < 0.25 * source_length AS short FROM m)"""

# The chunker as a recursion over (start, end): stops are searched backwards from the end.
_STOP = "CASE WHEN strpos(reverse(substr(body, 1, (start_ + {t})::INT + length({s}))), reverse({s})) = 0 THEN -1 ELSE least(start_ + {t} + length({s}), n) - strpos(reverse(substr(body, 1, (start_ + {t})::INT + length({s}))), reverse({s})) - length({s}) + 1 END"
_BEST = "greatest(" + ", ".join(_STOP.replace("{s}", s).replace("{t}", "1500") for s in ("chr(10) || chr(10)", "'。'", "'. '")) + ")"
_END = f"CASE WHEN start_ + 1500 >= n THEN n WHEN {_BEST} > start_ + 900 THEN {_BEST} + 1 ELSE start_ + 1500 END"
_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_CHUNKS = f"""bodies AS (SELECT doc_id AS id, trim(text, {_WS}) AS body, length(trim(text, {_WS})) AS n FROM documents WHERE trim(text, {_WS}) <> ''),
    steps AS (SELECT id, body, n, 0::BIGINT AS start_, 1 AS k FROM bodies
              UNION ALL SELECT id, body, n, greatest(start_ + 1, e - 150), k + 1 FROM (SELECT *, {_END} AS e FROM steps) WHERE e < n),
    chunks0 AS (SELECT id, k, trim(substr(body, start_ + 1, ({_END} - start_)::BIGINT), {_WS}) AS content FROM steps),
    chunks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY k)::INT AS chunk_no, '正文' AS section_path, content FROM chunks0 WHERE content <> '')"""


def _articles(spark, sf):
    return b.ledger(spark, sf).select(F.col("doc_id").alias("id"), "title", "publisher", F.when(F.col("doc_id") % 3 == 0, F.col("title")).when(F.col("doc_id") % 3 == 1, "").alias("core_view"))


def _built(spark, sf):
    return decisions.build(b.scenarios(spark, sf))


def _sources(spark, sf):
    s = b.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("source_id"), F.when(k % 9 != 0, F.concat(F.lit("pub"), k % 3)).alias("publisher"), F.when(k % 4 != 0, F.concat(F.lit("2026-0"), k % 9 + 1, F.lit("-1"), k % 10)).alias("published_at"), F.when(k % 6 == 0, "http://x.example").when(k % 6 == 1, "/archive/x").otherwise("https://x.example/a").alias("url"))


_SOURCES = "sources AS (SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 9 <> 0 THEN 'pub' || s_suppkey % 3 END AS publisher, CASE WHEN s_suppkey % 4 <> 0 THEN '2026-0' || (s_suppkey % 9 + 1) || '-1' || s_suppkey % 10 END AS published_at, CASE s_suppkey % 6 WHEN 0 THEN 'http://x.example' WHEN 1 THEN '/archive/x' ELSE 'https://x.example/a' END AS url FROM supplier)"


def _cited(spark, sf):
    i = F.col("ordinal")
    return _built(spark, sf).withColumn("evidence_ids", F.array(i % 130 + 1, i * 7 % 130 + 1, i % 50 + 1))


_CITED = f"{b.SCENARIOS}, cited AS (SELECT *, [ordinal % 130 + 1, ordinal * 7 % 130 + 1, ordinal % 50 + 1] AS evidence_ids FROM built)"


def _faulty(spark, sf):
    i = F.col("ordinal")
    rows = _cited(spark, sf).withColumn("title", F.when(i % 3 == 0, F.concat(F.lit("用 AI "), "title")).otherwise(F.col("title"))).withColumn("short_title", F.substring("title", 1, (i % 20).cast("int")))
    rows = rows.withColumn("prerequisite", F.when(i % 2 == 0, "pilot").otherwise(" ")).withColumn("total", F.col("total") + F.when(i % 7 == 0, 20).otherwise(0))
    return rows.withColumn("evidence_ids", F.when(i % 11 == 0, F.array().cast("array<bigint>")).otherwise(F.col("evidence_ids"))).withColumn("readiness", F.col("readiness") + F.when(i % 5 == 0, 5).otherwise(0))


def _pilots(spark, sf):
    part = b.scenarios(spark, sf)
    return part.groupBy("library").agg(F.sort_array(F.collect_list("ordinal")).alias("o")).select("library", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pilot_id"), "o").select("library", "pilot_id", F.when(F.col("pilot_id") == 2, F.lit("none")).otherwise(F.concat(F.lit("s-"), F.get("o", F.col("pilot_id") + 4).cast("string"))).alias("scenario_id"))


_CASES = "array<struct<company:string,market:string>>"


def _overlay(spark, sf):
    i = F.col("ordinal")
    base = b.scenarios(spark, sf).select("id", "ordinal", F.when(i % 3 != 0, F.array(F.struct(F.concat(F.lit("a"), i % 5).alias("company"), F.when(i % 2 == 0, "中国").alias("market")))).alias("cases"))
    extra = base.where(i % 4 == 0).select("id", F.array(F.struct(F.lit("z").alias("company"), F.lit(None).cast("string").alias("market"))).alias("cases"))
    return decisions.overlay(base.drop("ordinal"), extra).select("id", F.to_json("cases").alias("cases"), F.size("cases").alias("n_cases"))


def _indexed(spark, sf):
    """documents as numbered lines in two overlapping parts, one with cut lines."""
    d = b.table(spark, sf, "documents").where("length(text) > 0")
    lines = F.split("text", "\n")
    part = lambda keep, cut: F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(keep(i), F.concat(F.lit("L"), i + 1, F.lit(": "), F.substring(x, 1, cut)))), lambda x: x.isNotNull()), "\n")
    return d.select(F.col("doc_id").alias("page"), part(lambda i: i % 3 != 2, 40).alias("raw")).unionByName(d.select(F.col("doc_id").alias("page"), part(lambda i: i % 2 == 0, 100_000).alias("raw")))


def _clock(seconds):
    return F.format_string("%02d:%02d:%02d.000", F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60)


def _captions(spark, sf, most=None):
    """documents as caption files, one cue of two lines a line of text; of the first ``most`` lines where given."""
    lines = F.split("text", "\n") if most is None else F.slice(F.split("text", "\n"), 1, most)
    words = lambda x: F.replace(x, F.lit("the"), F.lit("R&amp;D"))
    cues = F.transform(lines, lambda x, i: F.concat(F.lit("\n\n"), i + 1, F.lit("\n"), _clock(i), F.lit(" --> "), _clock(i + 1), F.lit("\n<c>"), words(x), F.lit("</c>\n"), words(x)))
    return b.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("WEBVTT\n"), F.array_join(cues, "")).alias("vtt"))


def _events(spark, sf):
    e = b.table(spark, sf, "events")
    line = F.when(F.col("event_id") % 10 == 0, "").when(F.col("event_id") % 11 == 0, '{"type": ').otherwise(F.to_json(F.struct(F.col("event_type").alias("type"), F.when(F.col("event_id") % 2 == 0, "retrieving").alias("stage"))))
    return scans.event_lines(e.select(line.alias("value"))).groupBy("type", "stage", "message").agg(F.count("*").alias("n"))


QUERIES = {
    "translation_verify": lambda s, sf: _wide(translation.verify(b.pairs(s, sf))),
    "translation_verdicts": lambda s, sf: translation.verdicts(translation.verify(b.pairs(s, sf))),
    "missing_numbers": lambda s, sf: translation.altered(b.pairs(s, sf), text.numbers),
    "missing_number_forms": lambda s, sf: translation.missing_forms(b.pairs(s, sf)),
    "missing_urls": lambda s, sf: translation.altered(b.pairs(s, sf), text.urls),
    "lang_detect": lambda s, sf: b.pairs(s, sf).select("id", text.source_language(F.col("source")).alias("of_source"), text.source_language(F.col("translation")).alias("of_translation")),
    "split_for_translation": lambda s, sf: chunks.split(_plain(s, sf), "id", "text", 500).groupBy("id").agg(F.count("*").alias("parts"), F.max(F.length("content")).alias("longest"), F.sum(F.length("content")).alias("characters")),
    "chunk_corpus": lambda s, sf: chunks.chunk(_plain(s, sf), "id", "text").select("id", "chunk_no", "section_path", "content"),
    "chunk_fingerprints": lambda s, sf: chunks.chunk(_plain(s, sf), "id", "text").select("chunk_id", "fingerprint"),
    "section_paths": lambda s, sf: chunks.chunk(_markdown(s, sf), "id", "markdown", 1_000_000).select("id", "chunk_no", "section_path", F.length("content").alias("characters")),
    "corpus_verify": lambda s, sf: chunks.corpus_violations(chunks.chunk(_plain(s, sf).where("id % 10 != 0"), "id", "text"), _plain(s, sf)),
    "browser_index": lambda s, sf: chunks.browser_index(chunks.chunk(_plain(s, sf), "id", "text"), _articles(s, sf)),
    "first_paragraphs": lambda s, sf: _plain(s, sf).select("id", text.first_paragraph(F.col("text")).alias("lead"), text.escape_html(F.col("text")).alias("escaped")),
    "label_distance": lambda s, sf: b.ledger(s, sf).select("id", F.round(text.label_distance(*[F.regexp_replace(F.substring(c, i, 40), "[^ -~]", "") for c, i in (("title", 1), ("content", 10))]), 9).alias("distance")),
    # Whole labels of any script: the title and the text's second line. No SQL: DuckDB's levenshtein counts bytes.
    "label_distance_whole": lambda s, sf: b.ledger(s, sf, merge=True).select("id", F.round(text.label_distance(F.col("title"), F.get(F.split("content", "\n"), F.lit(1))), 9).alias("distance")),
    "browse_filter": lambda s, sf: browse.browse(b.ledger(s, sf), year="2026", category="ai-operating-model", priority="must-read", keyword=" THE ").select("id", "publisher", "title"),
    "sort_by_date": lambda s, sf: (lambda rows: browse.page(rows, browse.ordered(rows, "date"), 2).select("id", "published_at", scores.normalized(F.col("score_total"), F.col("score_scale")).alias("percent")))(b.ledger(s, sf)),
    "sort_by_score": lambda s, sf: (lambda rows: browse.page(rows, browse.ordered(rows, "score"), 1).select("id", "published_at", scores.normalized(F.col("score_total"), F.col("score_scale")).alias("percent")))(b.ledger(s, sf)),
    "facets": lambda s, sf: browse.facets(b.ledger(s, sf), ["publisher", "category", "priority", "lang"]),
    "radar_build": lambda s, sf: _built(s, sf).select("id", "library", "number", "priority", *decisions.DIMENSIONS, "total", "red_line", "matrix_rank", "x", "y", "value"),
    "radar_violations": lambda s, sf: decisions.violations(_faulty(s, sf)),
    "radar_rank": lambda s, sf: decisions.ranked(_cited(s, sf), _sources(s, sf)).select("id", "library", "total", "latest", "rank"),
    "radar_matrix": lambda s, sf: _built(s, sf).where("matrix_rank is not null").select("library", "matrix_rank", "id"),
    "evidence_dates": lambda s, sf: decisions.latest_dates(_cited(s, sf), _sources(s, sf)),
    "unknown_evidence": lambda s, sf: decisions.unknown_evidence(_cited(s, sf), _sources(s, sf)),
    "narrow_evidence": lambda s, sf: decisions.narrow_evidence(_cited(s, sf), _sources(s, sf)),
    "source_violations": lambda s, sf: decisions.source_violations(_sources(s, sf)),
    "pilot_fallback": lambda s, sf: decisions.pilots(_pilots(s, sf), _built(s, sf)),
    "overlay_merge": _overlay,
    "library_counts": lambda s, sf: _built(s, sf).groupBy("library").agg(F.count("*").alias("scenarios"), F.count_if(F.col("priority") == "P0").alias("p0"), F.count("matrix_rank").alias("ranked")),
    "indexed_page_merge": lambda s, sf: scans.indexed_lines(_indexed(s, sf)).withColumn("coverage", F.round("coverage", 9)),
    "indexed_page_gate": lambda s, sf: scans.accepted(scans.indexed_lines(_indexed(s, sf)), 0.6).select("page", "captured"),
    "vtt_dedup": lambda s, sf: _captions(s, sf, 20).select("doc_id", scans.transcript(F.col("vtt")).alias("transcript")),
    "vtt_dedup_whole": lambda s, sf: _captions(s, sf).select("doc_id", scans.transcript(F.col("vtt")).alias("transcript")),
    "event_lines": _events,
}

_BUILT = f"WITH {b.SCENARIOS}"
_LATEST = f"WITH {_CITED}, {_SOURCES}, used AS (SELECT id, library, priority, card, unnest(evidence_ids) AS source_id FROM cited), latest AS (SELECT id, max(try_cast(published_at AS DATE)) AS latest FROM used LEFT JOIN sources USING (source_id) GROUP BY id)"
_SPLIT_LINES = "SELECT doc_id AS page, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 0)"
_INDEXED = f"""lines AS ({_SPLIT_LINES}), parts AS (SELECT page, i, substr(x, 1, 40) AS t FROM lines WHERE i % 3 <> 2 UNION ALL SELECT page, i, substr(x, 1, 100000) FROM lines WHERE i % 2 = 0),
    best AS (SELECT page, i, arg_max(t, (length(t), t)) AS t FROM parts GROUP BY ALL), pages0 AS (SELECT page, string_agg(t, chr(10) ORDER BY i) AS body, count(*)::INT AS captured, max(i) + 1 AS total FROM best GROUP BY page)"""
_SORTED = "floor(score_total / coalesce(score_scale, 100.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"
_F = f"""{_CITED}, f AS (SELECT id, library, priority, i, ordinal, matrix, CASE WHEN ordinal % 3 = 0 THEN '用 AI ' || title ELSE title END AS title, card, list_sum(card) AS s, CASE WHEN ordinal % 7 = 0 THEN 20 ELSE 0 END AS extra,
    CASE WHEN ordinal % 5 = 0 THEN 5 ELSE 0 END AS more, ordinal % 11 = 0 AS bare FROM (SELECT *, CASE WHEN i < 12 THEN i + 1 END AS matrix FROM cited))"""

ORACLES = {
    "translation_verify": f"WITH {_VERIFIED} SELECT * EXCLUDE (e), array_to_string(e, ',') AS errors, len(e) = 0 AS ok FROM verified",
    "translation_verdicts": f"WITH {_VERIFIED} SELECT error, count(*) AS n FROM (SELECT unnest(e) AS error FROM verified) GROUP BY 1 UNION ALL SELECT 'passed', count(*) FILTER (len(e) = 0) FROM verified",
    "missing_numbers": rf"WITH {b.PAIRS}, s AS (SELECT id, unnest(regexp_extract_all(source, '\d+(?:[.,]\d+)*[%‰]?')) AS value FROM pairs), t AS (SELECT id, unnest(regexp_extract_all(translation, '\d+(?:[.,]\d+)*[%‰]?')) AS value FROM pairs), c AS (SELECT id, value, count(*) AS required FROM s GROUP BY ALL), d AS (SELECT id, value, count(*) AS actual FROM t GROUP BY ALL) SELECT id, value, required, coalesce(actual, 0) AS actual FROM c LEFT JOIN d USING (id, value) WHERE coalesce(actual, 0) < required",
    "missing_number_forms": rf"""WITH {b.PAIRS}, s AS (SELECT id, unnest(regexp_extract_all(source, '\d+(?:[.,]\d+)*[%‰]?')) AS form, unnest(range(len(regexp_extract_all(source, '\d+(?:[.,]\d+)*[%‰]?')))) AS pos FROM pairs), t AS (SELECT id, regexp_replace(unnest(regexp_extract_all(translation, '\d+(?:[.,]\d+)*[%‰]?')), '[%‰]$', '') AS value FROM pairs),
        c AS (SELECT id, regexp_replace(form, '[%‰]$', '') AS value, count(*) AS required, arg_max(form, pos) AS form FROM s GROUP BY 1, 2), d AS (SELECT id, value, count(*) AS actual FROM t GROUP BY ALL) SELECT id, value, form, required, coalesce(actual, 0) AS actual FROM c LEFT JOIN d USING (id, value) WHERE coalesce(actual, 0) < required""",
    "missing_urls": f"WITH {b.PAIRS}, s AS (SELECT id, unnest({_URLS.replace('{c}', 'source')}) AS value FROM pairs), t AS (SELECT id, unnest({_URLS.replace('{c}', 'translation')}) AS value FROM pairs), c AS (SELECT id, value, count(*) AS required FROM s GROUP BY ALL), d AS (SELECT id, value, count(*) AS actual FROM t GROUP BY ALL) SELECT id, value, required, coalesce(actual, 0) AS actual FROM c LEFT JOIN d USING (id, value) WHERE coalesce(actual, 0) < required",
    "lang_detect": rf"WITH {b.PAIRS} SELECT id, CASE WHEN len(regexp_extract_all(source, '\p{{Han}}')) > 0.4 * len(regexp_extract_all(source, '[A-Za-z]')) THEN 'zh' ELSE 'en' END AS of_source, CASE WHEN len(regexp_extract_all(translation, '\p{{Han}}')) > 0.4 * len(regexp_extract_all(translation, '[A-Za-z]')) THEN 'zh' ELSE 'en' END AS of_translation FROM pairs",
    "chunk_corpus": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM chunks",
    "section_paths": rf"""WITH m AS (SELECT doc_id AS id, '# ' || source || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 4 = 3 THEN CASE WHEN (i - 1) % 8 = 3 THEN '## ' ELSE '### ' END || substr(x, 1, 30) || chr(10) || chr(10) || x ELSE x END), chr(10) || chr(10)) AS md FROM documents),
        p AS (SELECT id, unnest(range(len(l))) AS k, unnest(l) AS line FROM (SELECT id, string_split(md, chr(10)) AS l FROM m)),
        h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\s+.+$') AS is_head, length(regexp_extract(line, '^(#{{1,6}})\s', 1)) AS level, trim(regexp_extract(line, '^#{{1,6}}\s+(.+)$', 1), {_WS}) AS label FROM p),
        s AS (SELECT *, count(*) FILTER (is_head) OVER (PARTITION BY id ORDER BY k) AS sec FROM h),
        heads AS (SELECT id, sec, level, label, last_value(CASE WHEN level = 1 THEN label END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN label END IGNORE NULLS) OVER w AS h2 FROM s WHERE is_head WINDOW w AS (PARTITION BY id ORDER BY k)),
        bodies AS (SELECT id, sec, trim(string_agg(line, chr(10) ORDER BY k) FILTER (NOT is_head), {_WS}) AS body FROM s GROUP BY ALL)
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY sec)::INT AS chunk_no, CASE level WHEN 1 THEN label WHEN 2 THEN h1 || ' › ' || label ELSE h1 || ' › ' || h2 || ' › ' || label END AS section_path, length(body)::INT AS characters
        FROM bodies JOIN heads USING (id, sec) WHERE body <> ''""",
    "chunk_fingerprints": f"WITH RECURSIVE {_CHUNKS} SELECT id || ':' || lpad(chunk_no::VARCHAR, greatest(3, length(chunk_no::VARCHAR))::INT, '0') AS chunk_id, sha256(content) AS fingerprint FROM chunks",
    "corpus_verify": f"SELECT doc_id::VARCHAR AS subject, 'no chunks' AS violation FROM documents WHERE doc_id % 10 = 0 OR trim(coalesce(text, ''), {_WS}) = ''",
    "browser_index": f"WITH RECURSIVE {b.LEDGER}, {_CHUNKS}, c AS (SELECT id, count(*) AS chunk_count, arg_min(content, chunk_no) AS first_chunk FROM chunks GROUP BY id) SELECT doc_id AS id, title, publisher, coalesce(chunk_count, 0)::BIGINT AS chunk_count, coalesce(CASE WHEN doc_id % 3 = 0 THEN nullif(title, '') END, substr(first_chunk, 1, 220), '') AS summary FROM ledger LEFT JOIN c ON c.id = doc_id",
    "first_paragraphs": r"""SELECT doc_id AS id, substr(coalesce(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n+'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: length(x) >= 20 AND NOT regexp_matches(x, '^(#|!\[|\d{4}-\d{2}-\d{2})'))[1], ''), 1, 260) AS lead,
        replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""",
    "label_distance": f"WITH {b.LEDGER}, l AS (SELECT id, regexp_replace(substr(title, 1, 40), '[^ -~]', '', 'g') AS x, regexp_replace(substr(content, 10, 40), '[^ -~]', '', 'g') AS y FROM ledger) SELECT id, round(coalesce(levenshtein(x, y) / nullif(greatest(length(x), length(y)), 0), 0)::DOUBLE, 9) AS distance FROM l",
    "browse_filter": f"WITH {b.LEDGER} SELECT id, publisher, title FROM ledger WHERE starts_with(published_at, '2026') AND category = 'ai-operating-model' AND priority = 'must-read' AND contains(lower(title || ' ' || publisher || ' ' || category), 'the')",
    "sort_by_date": f"WITH {b.LEDGER}, r AS (SELECT id, published_at, {_SORTED} AS percent FROM ledger) SELECT * FROM r ORDER BY published_at DESC NULLS LAST, percent DESC NULLS LAST, id LIMIT 30 OFFSET 30",
    "sort_by_score": f"WITH {b.LEDGER}, r AS (SELECT id, published_at, {_SORTED} AS percent FROM ledger) SELECT * FROM r ORDER BY percent DESC NULLS LAST, published_at DESC NULLS LAST, id LIMIT 30",
    "facets": f"WITH {b.LEDGER} " + " UNION ALL ".join(f"SELECT '{c}' AS facet, {c} AS value, count(*) AS n FROM ledger WHERE coalesce({c}, '') <> '' GROUP BY 2" for c in ("publisher", "category", "priority", "lang")),
    "radar_build": _BUILT + ", p AS (SELECT *, [[88, 12], [68, 16], [82, 30], [58, 36], [42, 24], [28, 12], [48, 46], [38, 58], [25, 42], [18, 66], [10, 82], [8, 32]][i + 1] AS xy FROM built) SELECT id, library, lpad((i + 1)::VARCHAR, greatest(2, length((i + 1)::VARCHAR))::INT, '0') AS number, priority, " + ", ".join(f"card[{k}]::INT AS {d}" for k, d in enumerate(decisions.DIMENSIONS, 1)) + ", list_sum(card)::INT AS total, priority = 'P3' AS red_line, CASE WHEN i < 12 THEN (i + 1)::INT END AS matrix_rank, coalesce(xy[1], 12 + (i * 17) % 76)::INT AS x, coalesce(xy[2], 18 + (i * 23) % 70)::INT AS y, CASE priority WHEN 'P0' THEN 5.0 WHEN 'P1' THEN 4.5 WHEN 'P2' THEN 4.0 ELSE 3.5 END::DOUBLE AS value FROM p",
    "radar_violations": f"""WITH {_F} SELECT id, 'readiness out of range' AS violation FROM f WHERE card[3] + more > 15 UNION ALL SELECT id, 'total is not the sum' FROM f WHERE s + extra <> s + more
        UNION ALL SELECT id, 'scorecard does not fit the priority' FROM f WHERE NOT CASE priority WHEN 'P0' THEN s + extra >= 80 WHEN 'P1' THEN s + extra BETWEEN 65 AND 79 WHEN 'P2' THEN s + extra >= 50 AND (s + extra <= 64 OR ordinal % 2 = 0) ELSE TRUE END
        UNION ALL SELECT id, 'number must have two digits' FROM f WHERE i >= 99 UNION ALL SELECT id, 'title must start with 用 AI or 让 AI' FROM f WHERE NOT regexp_matches(title, '^(用 AI|让 AI)')
        UNION ALL SELECT id, 'short title must have 4 to 14 characters' FROM f WHERE length(substr(title, 1, (ordinal % 20)::INT)) NOT BETWEEN 4 AND 14
        UNION ALL SELECT id, 'no evidence' FROM f WHERE bare""",
    "radar_rank": _LATEST + " SELECT c.id, library, list_sum(card)::INT AS total, latest, row_number() OVER (PARTITION BY library ORDER BY list_sum(card) DESC, card[4] DESC, latest DESC NULLS LAST, c.id)::INT AS rank FROM cited c LEFT JOIN latest USING (id)",
    "radar_matrix": _BUILT + " SELECT library, (i + 1)::INT AS matrix_rank, id FROM built WHERE i < 12",
    "evidence_dates": _LATEST + " SELECT * FROM latest",
    "unknown_evidence": _LATEST + " SELECT id, source_id FROM used WHERE source_id NOT IN (SELECT source_id FROM sources)",
    "narrow_evidence": _LATEST + " SELECT id, count(DISTINCT publisher) AS publishers FROM used LEFT JOIN sources USING (source_id) WHERE priority = 'P0' GROUP BY id HAVING publishers < 2",
    "source_violations": f"WITH {_SOURCES} SELECT source_id, 'url' AS violation FROM sources WHERE NOT (starts_with(url, 'https://') OR starts_with(url, '/archive/')) UNION ALL SELECT source_id, 'date' FROM sources WHERE published_at IS NOT NULL AND try_cast(published_at AS DATE) IS NULL",
    "pilot_fallback": _BUILT + """, o AS (SELECT library, list_sort(list(ordinal)) AS o FROM rows0 GROUP BY library), p AS (SELECT library, pilot_id, CASE WHEN pilot_id = 2 THEN 'none' ELSE 's-' || o[(pilot_id + 5)::INT] END AS scenario_id FROM o, (VALUES (1), (2), (3)) v(pilot_id))
        SELECT p.library, pilot_id, CASE WHEN d.id IS NOT NULL THEN scenario_id ELSE z.id END AS scenario, coalesce(d.title, z.title) AS title, d.id IS NOT NULL AS explicit
        FROM p LEFT JOIN built d ON d.library = p.library AND d.id = p.scenario_id LEFT JOIN built z ON z.library = p.library AND z.priority = 'P0' AND z.i + 1 = pilot_id""",
    "overlay_merge": """WITH b AS (SELECT 's-' || p_partkey AS id, p_partkey AS k FROM part), c AS (SELECT id, k, CASE WHEN k % 3 <> 0 THEN ['{"company":"a' || k % 5 || '","market":"' || CASE WHEN k % 2 = 0 THEN '中国' ELSE '国际' END || '"}'] ELSE [] END || CASE WHEN k % 4 = 0 THEN ['{"company":"z","market":"国际"}'] ELSE [] END AS c FROM b)
        SELECT id, '[' || array_to_string(c, ',') || ']' AS cases, len(c)::INT AS n_cases FROM c""",
    "library_counts": _BUILT + " SELECT library, count(*) AS scenarios, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (i < 12) AS ranked FROM built GROUP BY library",
    "indexed_page_merge": f"WITH {_INDEXED} SELECT page, body, captured, total, round(captured / total, 9)::DOUBLE AS coverage FROM pages0",
    "indexed_page_gate": f"WITH {_INDEXED} SELECT page, captured FROM pages0 WHERE captured / total >= 0.6 AND length(body) >= 300",
    "vtt_dedup": f"WITH l AS (SELECT doc_id, unnest(range(len(l))) AS i, trim(replace(unnest(l), 'the', 'R&D')) AS x FROM (SELECT doc_id, string_split(text, chr(10))[:20] AS l FROM documents)), f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$') GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i), '') AS transcript FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id",
    "vtt_dedup_whole": f"WITH l AS (SELECT doc_id, unnest(range(len(l))) AS i, trim(replace(unnest(l), 'the', 'R&D')) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), f AS (SELECT doc_id, x, min(i) AS i FROM l WHERE x <> '' AND NOT regexp_matches(x, '^[0-9]+$') GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i), '') AS transcript FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id",
    "event_lines": "SELECT CASE WHEN event_id % 11 = 0 THEN 'error' ELSE event_type END AS type, CASE WHEN event_id % 11 <> 0 AND event_id % 2 = 0 THEN 'retrieving' END AS stage, CASE WHEN event_id % 11 = 0 THEN 'malformed event' END AS message, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY ALL",
}
