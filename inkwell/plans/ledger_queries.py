"""Ledger, taxonomy, refresh and archive queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores, text, urls
from inkwell.operators import archive, ledger
from inkwell.plans import bindings as b

DOMAINS = ["example.com", "example.org"]


def _candidates(spark, sf):
    """pages as candidates: status, reason and date by rule."""
    p = b.table(spark, sf, "pages")
    status = F.when(F.col("page_id") % 5 == 0, "excluded").when(F.col("page_id") % 17 == 0, "failed").when(F.col("page_id") % 23 == 0, "unknown").otherwise("included")
    date = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("2026-02-"), F.format_string("%02d", F.col("page_id") % 31))).when(F.col("page_id") % 3 == 1, "2026-08-20")
    return p.select(
        F.col("page_id").alias("candidate_id"), "url", urls.host(F.col("url")).alias("publisher"), status.alias("status"),
        F.when(F.col("page_id") % 10 != 0, "out of scope").alias("reason"), date.alias("published_at"),
        F.when(F.col("page_id") % 4 != 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("inspected_title"),
    )


def _domains():
    return F.array(*map(F.lit, DOMAINS))


_CANDIDATES = r"""cand AS (SELECT page_id AS candidate_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS publisher,
    CASE WHEN page_id % 5 = 0 THEN 'excluded' WHEN page_id % 17 = 0 THEN 'failed' WHEN page_id % 23 = 0 THEN 'unknown' ELSE 'included' END AS status,
    CASE WHEN page_id % 10 <> 0 THEN 'out of scope' END AS reason,
    CASE page_id % 3 WHEN 0 THEN '2026-02-' || lpad((page_id % 31)::VARCHAR, 2, '0') WHEN 1 THEN '2026-08-20' END AS published_at,
    CASE WHEN page_id % 4 <> 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) END AS inspected_title FROM pages)"""


def _canon(col):
    bare = f"regexp_replace({col}, '#.*$', '')"
    place = rf"regexp_replace(regexp_extract({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '')"
    kept = rf"list_filter(string_split(regexp_extract({bare}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|fbclid|gclid)', 'i'))"
    return rf"(lower(regexp_extract({bare}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) || CASE WHEN {place} = '' THEN '/' ELSE {place} END || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END)"


def _key(col):
    return rf"lower(regexp_replace(regexp_replace({col}, '#.*$', ''), '/+(\?|$)', '\1', 'g'))"


def _slug(col):
    last = rf"lower(coalesce(list_filter(string_split(regexp_extract({col}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')[-1], 'article'))"
    text = rf"substr(regexp_replace(regexp_replace({last}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 90)"
    return f"CASE WHEN {text} = '' THEN 'article' ELSE {text} END"


def _overrides(spark, sf):
    p = b.table(spark, sf, "pages").where("page_id % 2 = 0")
    return p.groupBy(urls.canonical(F.col("url")).alias("url")).agg(F.concat(F.lit("研究 "), F.min("page_id").cast("string")).alias("title_zh"), F.min(F.when(F.col("page_id") % 8 == 0, F.concat(F.lit("How growth case "), F.col("page_id")))).alias("title_original"))


def _existing(spark, sf):
    return b.table(spark, sf, "pages").where("page_id % 6 = 1").select(urls.host(F.col("url")).alias("publisher"), (F.col("page_id") % 9).cast("int").alias("archive_index"))


def _records(spark, sf):
    """Candidates' points as ledger records with planted faults."""
    rows = b.ledger(spark, sf).withColumn("points", ledger.points(F.col("title")))
    i = F.col("doc_id")
    return rows.select(
        i.alias("row_id"), F.when(i % 13 != 0, F.col("id")).alias("id"), "publisher", F.when(i % 19 == 0, F.replace("url", F.lit("https:"), F.lit("http:"))).otherwise(F.col("url")).alias("source_url"), "title", "priority",
        *[F.when(i % 3 == 0, F.lit(None)).otherwise(F.col(f"points.{d}") + F.when(i % 29 == 0, 30).otherwise(0)).cast("double").alias(d) for d in scores.MAXIMA],
        (F.col("points.total") + F.when(i % 31 == 0, 1).otherwise(0)).cast("double").alias("total"),
    )


def _pattern(words):
    return words.replace("'", "''")


_EVIDENCE, _APPLIED = _pattern(ledger.EVIDENCE), _pattern(ledger.APPLIED)


def _points(col):
    return f"CASE WHEN regexp_matches({col}, '{_EVIDENCE}', 'i') THEN [27, 20, 21, 12, 80] WHEN regexp_matches({col}, '{_APPLIED}', 'i') THEN [25, 20, 21, 9, 75] ELSE [23, 19, 20, 9, 71] END"


def _class(col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{_pattern(p)}', 'i') THEN '{name}'" for p, name, _ in ledger.RULES) + f" ELSE '{ledger.DEFAULT[0]}' END"


_ALIASES = ", ".join(f"('{a}', '{name}')" for name, aliases in ledger.TOPICS.items() for a in aliases)


def _topics(spark, sf):
    return b.ledger(spark, sf).withColumn("category", F.when(F.col("doc_id") % 9 == 0, "AI 战略与价值").when(F.col("doc_id") % 50 == 1, "unknown-topic").otherwise(F.col("category")))


def _migrated(spark, sf):
    return ledger.migrate(_topics(spark, sf), F.lit("2026-08-24"))


_MIGRATED = f"""{b.LEDGER}, a(alias, topic) AS (VALUES {_ALIASES}),
    cat AS (SELECT id, CASE WHEN doc_id % 9 = 0 THEN 'AI 战略与价值' WHEN doc_id % 50 = 1 THEN 'unknown-topic' ELSE category END AS category FROM ledger),
    migrated AS (SELECT id AS article_id, category AS topic_from, topic AS topic_to, CASE WHEN category = topic THEN 'identity' ELSE 'alias' END AS mapping_rule,
                        'zh-management-v1' AS taxonomy_version, '2026-08-24' AS migrated_at FROM cat LEFT JOIN a ON alias = category)"""


def _state(spark, sf):
    """events as the state log of an archive run: the last event of each user."""
    e = b.table(spark, sf, "events")
    last = e.groupBy(F.col("user_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.max("event_id").alias("event_id"))
    http = F.when(F.col("event_id") % 11 == 0, 403).when(F.col("event_id") % 13 == 0, 500).when(F.col("event_id") % 17 == 0, 404).otherwise(200)
    return last.select(F.col("user_id").alias("id"), F.concat(F.lit("https://example.com/"), "user_id").alias("url"), http.alias("http"), archive.outcome(http, F.lit(False)).alias("status"), F.when(http == 200, F.md5(F.col("event_id").cast("string"))).alias("sha256"), F.col("kind").alias("extraction"))


_STATE = """last AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(event_id) AS event_id FROM events GROUP BY user_id),
    h AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 403 WHEN event_id % 13 = 0 THEN 500 WHEN event_id % 17 = 0 THEN 404 ELSE 200 END AS http FROM last),
    state AS (SELECT user_id AS id, 'https://example.com/' || user_id AS url, http, CASE WHEN http IN (401, 403, 451) THEN 'blocked' WHEN http >= 400 THEN 'failed' ELSE 'downloaded' END AS status,
                     CASE WHEN http = 200 THEN md5(event_id::VARCHAR) END AS sha256, kind AS extraction FROM h)"""


def _wanted(spark, sf):
    return b.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://example.com/"), F.col("c_custkey"), F.when(F.col("c_custkey") % 7 == 0, "/moved").otherwise("")).alias("url"))


_WANTED = "wanted AS (SELECT c_custkey AS id, 'https://example.com/' || c_custkey || CASE WHEN c_custkey % 7 = 0 THEN '/moved' ELSE '' END AS url FROM customer)"


def _audited(spark, sf):
    return b.ledger(spark, sf).select("id", F.when(F.col("doc_id") % 41 != 0, F.col("publisher")).alias("publisher"), urls.canonical(F.col("url")).alias("url"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 5 != 0).alias("verified"))


def _queue(spark, sf):
    return archive.queue(b.pairs(spark, sf).select("id", "publisher", F.col("id").alias("archive_index"), "source", "translation", (F.col("id") % 4 != 0).alias("verified")))


_QUEUE = f"""{b.PAIRS}, queue AS (SELECT id, publisher, id AS archive_index,
    CASE WHEN len(regexp_extract_all(source, '\\p{{Han}}')) > 0.4 * len(regexp_extract_all(source, '[A-Za-z]')) THEN 'zh' ELSE 'en' END AS source_language, length(source)::INT AS source_characters,
    CASE WHEN translation = '' THEN 'pending' WHEN id % 4 <> 0 THEN 'complete' ELSE 'invalid' END AS status FROM pairs)"""

def _pointed(spark, sf):
    """documents behind points of four dimensions, by name and in order; some lack one."""
    i = F.col("doc_id")
    named = F.concat(F.lit("CV "), i % 36, F.lit(", impact"), i % 26, F.when(i % 3 != 0, F.concat(F.lit(" SR\t"), i % 25)).otherwise(""), F.lit(" Evidence "), i % 16, F.lit("\n"), text.blank(F.col("text")))
    ordered = F.concat(i % 36, F.lit("/35 "), i % 26, F.lit(" / 25, "), F.when(i % 4 != 0, F.concat(i % 25, F.lit("/25 "))).otherwise(""), i % 16, F.lit("/15\n"), text.blank(F.col("text")))
    return b.table(spark, sf, "documents").select("doc_id", scores.labelled_dimensions(named).alias("named"), scores.ordered_dimensions(ordered).alias("ordered"))


_NAMED = "'CV ' || doc_id % 36 || ', impact' || doc_id % 26 || CASE WHEN doc_id % 3 <> 0 THEN ' SR' || chr(9) || doc_id % 25 ELSE '' END || ' Evidence ' || doc_id % 16 || chr(10) || coalesce(text, '')"
_ORDERED = "doc_id % 36 || '/35 ' || doc_id % 26 || ' / 25, ' || CASE WHEN doc_id % 4 <> 0 THEN doc_id % 25 || '/25 ' ELSE '' END || doc_id % 16 || '/15' || chr(10) || coalesce(text, '')"
_POINTS = {"content": "CV|Content", "impact": "IB|Impact", "relevance": "SR|Relevance", "evidence": "ES|Evidence"}


def _in_one(spark, sf):
    """Digests of three makes (one by topic, one with a scale, one plain) as one table."""
    rows = b.table(spark, sf, "documents").select(F.format_string("doc-%06d", "doc_id").alias("id"), F.col("source").alias("publisher"), F.concat(F.lit("https://example.com/a/"), "doc_id", F.lit("/?utm_source=x")).alias("source_url"), text.blank(F.col("lang")).alias("lang"))
    topics = rows.where("lang = 'en'").withColumn("topic", F.lit("governance")).drop("lang")
    scaled = rows.where("lang = 'fr'").withColumn("scale", F.lit(10)).drop("lang")
    found = ledger.union_scan(topics, scaled, rows.where("lang not in ('en', 'fr')").drop("lang"))
    return found.select("id", "publisher", "topic", "scale", urls.canonical(F.col("source_url")).alias("canonical_url"))


def _plain_texts(spark, sf):
    """Whole texts with white space of several scripts and markup, cleaned and escaped; digests of both."""
    col, i = F.col("text"), F.col("doc_id")
    wide = F.when(i % 3 == 0, F.replace(col, F.lit(" "), F.lit("\u00a0 "))).when(i % 3 == 1, F.concat(F.lit("\u3000 "), F.replace(col, F.lit("\n"), F.lit("\u2028")), F.lit("\t\u2003"))).otherwise(F.concat(F.lit("<a href='x'>\"&amp;\""), col))
    return b.table(spark, sf, "documents").select("doc_id", F.md5(text.clean(wide)).alias("clean_md5"), F.length(text.clean(wide)).alias("clean_characters"), F.md5(text.escape_html(wide)).alias("escaped_md5"))


_SPACES = r"[\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_WIDE = "CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', chr(160) || ' ') WHEN 1 THEN chr(12288) || ' ' || replace(text, chr(10), chr(8232)) || chr(9) || chr(8195) ELSE '<a href=''x''>\"&amp;\"' || text END"


QUERIES = {
    "canonical_urls": lambda s, sf: b.table(s, sf, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"), urls.merge_key(F.col("url")).alias("merge_key"), urls.slug(F.col("url")).alias("slug")),
    "url_dedup": lambda s, sf: b.table(s, sf, "pages").groupBy(F.lower(urls.canonical(F.col("url"))).alias("key")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page")),
    "url_parameters": lambda s, sf: b.table(s, sf, "pages").select("page_id", *[urls.parameter(F.col("url"), p).alias(p) for p in ("page", "ref", "utm_source")]),
    "host_allowlist": lambda s, sf: b.table(s, sf, "pages").select("page_id", urls.allowed(F.col("url"), _domains()).alias("allowed")),
    "candidate_coverage": lambda s, sf: ledger.coverage(_candidates(s, sf)),
    "candidate_violations": lambda s, sf: ledger.candidate_violations(_candidates(s, sf), _domains()),
    "refresh_records": lambda s, sf: ledger.refresh(_candidates(s, sf), _overrides(s, sf), _existing(s, sf)),
    "record_violations": lambda s, sf: ledger.record_violations(_records(s, sf)),
    "ledger_duplicates": lambda s, sf: ledger.duplicates(b.ledger(s, sf)),
    "merge_ledger": lambda s, sf: ledger.merge(b.ledger(s, sf).where("doc_id % 3 = 0").select("id", "url", F.col("doc_id").alias("ordinal")), b.ledger(s, sf).where("doc_id % 3 != 0 or doc_id % 30 = 0").select("id", "url", F.col("doc_id").alias("ordinal"))),
    "ledger_override_join": lambda s, sf: ledger.override_join(b.ledger(s, sf).select("id", "priority", "title"), b.ledger(s, sf).where("doc_id % 2 = 0").select("id", F.lit("archived").alias("priority"), F.length("content").alias("characters")), ["priority", "title"]),
    "topic_normalize": lambda s, sf: _topics(s, sf).select("id", ledger.topic(F.col("category")).alias("topic")),
    "topic_migration_audit": _migrated,
    "topic_summary": lambda s, sf: _migrated(s, sf).agg(F.count("*").alias("articles"), F.count_distinct("topic_from").alias("input_topics"), F.count_distinct("topic_to").alias("output_topics"), F.count_if(F.col("topic_to").isNull()).alias("unknown")),
    "classify_titles": lambda s, sf: b.ledger(s, sf).select("id", ledger.classify(F.concat_ws(" ", "title", "category")).getField("primary").alias("category"), ledger.points(F.col("category")).getField("total").alias("total")),
    "score_labels": lambda s, sf: b.ledger(s, sf).select("id", scores.tier(F.col("score_total")).alias("tier"), scores.priority(F.col("score_total")).alias("priority"), scores.normalized(F.col("score_total"), F.col("score_scale")).alias("percent"), scores.priority_label(F.concat(F.lit(" Must  Read"), "lang")).alias("label"), scores.confidence_label(F.concat(F.lit("Confidence: "), F.when(F.col("lang") == "en", "Medium").when(F.col("lang") == "fr", "HIGH").otherwise("?"))).alias("confidence")),
    "change_status": lambda s, sf: ledger.change_status(b.ledger(s, sf).where("doc_id % 5 != 0").select("id", F.sha2("content", 256).alias("fingerprint")), b.ledger(s, sf).where("doc_id % 7 != 0").select("id", F.when(F.col("doc_id") % 11 == 0, "edited").otherwise(F.sha2("content", 256)).alias("fingerprint"))),
    "archive_index": lambda s, sf: archive.archive_index(b.ledger(s, sf).select("id", "publisher", "doc_id"), "publisher", "doc_id"),
    "archive_directories": lambda s, sf: b.ledger(s, sf).select("id", archive.directory_name(F.col("doc_id"), F.col("title")).alias("directory")),
    "archive_outcomes": lambda s, sf: _state(s, sf).select("id", "http", "status", F.array_join(archive.retried(F.col("http")), ",").alias("waits")),
    "resume_pending": lambda s, sf: archive.pending(_wanted(s, sf), _state(s, sf)),
    "retry_failed": lambda s, sf: archive.retry(_wanted(s, sf), _state(s, sf), "failed"),
    "status_summary": lambda s, sf: archive.summary(_state(s, sf)),
    "archive_audit": lambda s, sf: archive.audit(_audited(s, sf)),
    "id_set_equality": lambda s, sf: archive.set_difference(b.ledger(s, sf).where("doc_id % 50 != 0"), b.ledger(s, sf).where("doc_id % 60 != 0")),
    "manifest": lambda s, sf: archive.manifest(b.ledger(s, sf).withColumn("content", F.substring("content", 1, 80)), ["id", "publisher", "title", "published_at", "priority", "content"], "doc_id"),
    "manifest_whole": lambda s, sf: archive.manifest(b.ledger(s, sf, merge=True), ["id", "publisher", "title", "published_at", "priority", "content"], "doc_id"),
    "create_if_missing": lambda s, sf: archive.create_if_missing(b.ledger(s, sf).where("doc_id % 2 = 0").select("id", F.lit("kept").alias("body")), b.ledger(s, sf).where("doc_id % 3 = 0").select("id", F.lit("new").alias("body"))),
    "upsert_latest": lambda s, sf: archive.upsert(b.ledger(s, sf).select("id", F.lit(1).alias("updated_at"), F.length("content").alias("characters")), b.ledger(s, sf).where("doc_id % 4 = 0").select("id", (F.col("doc_id") % 3).cast("int").alias("updated_at"), F.lit(0).alias("characters"))),
    "safe_paths": lambda s, sf: b.ledger(s, sf).select("id", archive.safe_path(F.concat(F.lit("/archive/"), "publisher", F.lit("/"), F.when(F.col("doc_id") % 5 == 0, "%2e%2e").when(F.col("doc_id") % 7 == 0, ".hidden").otherwise(F.col("id")), F.when(F.col("doc_id") % 3 == 0, "/source.md").when(F.col("doc_id") % 3 == 1, "/reader.html").otherwise("/other.js"))).alias("safe")),
    "dimension_points": lambda s, sf: _pointed(s, sf).select("doc_id", *[F.col(f"{way}.{d}").alias(f"{way}_{d}") for way in ("named", "ordered") for d in scores.MAXIMA]),
    "digests_in_one": _in_one,
    "plain_texts": _plain_texts,
    "queue_entries": _queue,
    "queue_counts": lambda s, sf: archive.queue_counts(_queue(s, sf)),
    "queue_filter": lambda s, sf: archive.queue_filter(_queue(s, sf), "src3", 100, 600).where("source_language = 'en' and status != 'complete'"),
    "translation_batches": lambda s, sf: archive.batches(_queue(s, sf), 10, 20_000),
}

ORACLES = {
    "dimension_points": f"""WITH t AS (SELECT doc_id, {_NAMED} AS named, {_ORDERED} AS listed FROM documents),
        p AS (SELECT doc_id, {', '.join(f"TRY_CAST(nullif(regexp_extract(named, '(?i)(?:{v})[ \\t-\\r]*([0-9]+)', 1), '') AS INT) AS {k}" for k, v in _POINTS.items())},
              regexp_extract_all(listed, '([0-9]+)[ \\t-\\r]*/[ \\t-\\r]*(?:35|25|15)', 1) AS o FROM t),
        q AS (SELECT *, {' AND '.join(f'{k} IS NOT NULL' for k in _POINTS)} AS whole FROM p)
        SELECT doc_id, {', '.join(f'CASE WHEN whole THEN {k} END AS named_{k}' for k in _POINTS)}, {', '.join(f'CASE WHEN len(o) >= 4 THEN o[{n + 1}]::INT END AS ordered_{k}' for n, k in enumerate(_POINTS))} FROM q""",
    "digests_in_one": """SELECT 'doc-' || lpad(doc_id::VARCHAR, 6, '0') AS id, source AS publisher, CASE WHEN lang = 'en' THEN 'governance' END AS topic, CASE WHEN lang = 'fr' THEN 10::INT END AS scale,
        'https://example.com/a/' || doc_id AS canonical_url FROM documents""",
    "plain_texts": f"""WITH t AS (SELECT doc_id, coalesce({_WIDE}, '') AS w FROM documents), c AS (SELECT doc_id, w, trim(regexp_replace(w, '{_SPACES}', ' ', 'g'), ' ') AS c FROM t)
        SELECT doc_id, md5(c) AS clean_md5, length(c)::INT AS clean_characters, md5(replace(replace(replace(replace(replace(w, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS escaped_md5 FROM c""",
    "canonical_urls": f"SELECT page_id, {_canon('url')} AS canonical, {_key('url')} AS merge_key, {_slug('url')} AS slug FROM pages",
    "url_dedup": f"SELECT lower({_canon('url')}) AS key, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY 1",
    "url_parameters": "SELECT page_id, " + ", ".join(f"regexp_extract(url, '[?&]{p}=([^&#]*)', 1) AS {p}" for p in ("page", "ref", "utm_source")) + " FROM pages",
    "host_allowlist": f"WITH {_CANDIDATES} SELECT candidate_id AS page_id, publisher IN ('example.com', 'example.org') OR ends_with(publisher, '.example.com') OR ends_with(publisher, '.example.org') AS allowed FROM cand",
    "candidate_coverage": f"WITH {_CANDIDATES}, c AS (SELECT count(*) AS discovered, count(*) FILTER (status = 'included') AS included, count(*) FILTER (status = 'excluded') AS excluded, count(*) FILTER (status = 'failed') AS failed FROM cand) SELECT *, discovered = included + excluded + failed AS closed FROM c",
    "candidate_violations": f"""WITH {_CANDIDATES} SELECT candidate_id, 'status' AS violation FROM cand WHERE status NOT IN ('included', 'excluded', 'failed')
        UNION ALL SELECT candidate_id, 'https' FROM cand WHERE NOT starts_with(url, 'https://')
        UNION ALL SELECT candidate_id, 'domain' FROM cand WHERE NOT regexp_matches(publisher, '(^|[.])example[.](com|org)$')
        UNION ALL SELECT candidate_id, 'reason' FROM cand WHERE status <> 'included' AND reason IS NULL
        UNION ALL SELECT candidate_id, 'date' FROM cand WHERE published_at IS NOT NULL AND try_cast(published_at AS DATE) IS NULL
        UNION ALL SELECT candidate_id, 'repeated_url' FROM cand WHERE {_key('url')} IN (SELECT {_key('url')} FROM cand GROUP BY 1 HAVING count(*) > 1)""",
    "refresh_records": f"""WITH {_CANDIDATES},
        o AS (SELECT {_canon('url')} AS url, '研究 ' || min(page_id) AS title_zh, min(CASE WHEN page_id % 8 = 0 THEN 'How growth case ' || page_id END) AS title_original FROM pages WHERE page_id % 2 = 0 GROUP BY 1),
        e AS (SELECT lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS publisher, max(page_id % 9) AS last_index FROM pages WHERE page_id % 6 = 1 GROUP BY 1),
        j AS (SELECT c.*, coalesce(inspected_title, title_original) AS title, title_zh, coalesce(last_index, 0) AS last_index, {_canon('c.url')} AS canonical_url,
                     regexp_replace(c.publisher, '[^a-z0-9]+', '-', 'g') || '-' || {_slug('c.url')} AS base
              FROM cand c LEFT JOIN o ON lower({_canon('c.url')}) = lower({_canon('o.url')}) LEFT JOIN e ON e.publisher = c.publisher WHERE status = 'included'),
        x AS (SELECT *, coalesce(title, '') || ' ' || coalesce(title_zh, '') AS body, row_number() OVER (PARTITION BY base ORDER BY candidate_id) AS turn FROM j),
        y AS (SELECT *, ({_points('body')})[5] AS total FROM x)
        SELECT candidate_id, publisher, CASE WHEN turn = 1 THEN base ELSE base || '-' || turn END AS id, canonical_url, title, title_zh, {_class('body')} AS category, total::INT AS total,
               CASE WHEN total >= 78 THEN 'high' WHEN total >= 68 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN total >= 82 THEN 'must-read' WHEN total >= 74 THEN 'track' ELSE 'reference' END AS priority,
               (last_index + row_number() OVER (PARTITION BY publisher ORDER BY candidate_id))::BIGINT AS archive_index FROM y""",
    "record_violations": f"""WITH {b.LEDGER}, p AS (SELECT *, {_points('title')} AS pt, CASE WHEN doc_id % 29 = 0 THEN 30 ELSE 0 END AS add_ FROM ledger),
        r AS (SELECT doc_id AS row_id, CASE WHEN doc_id % 13 <> 0 THEN id END AS id, publisher, CASE WHEN doc_id % 19 = 0 THEN replace(url, 'https:', 'http:') ELSE url END AS u, title, priority,
                     CASE WHEN doc_id % 3 <> 0 THEN [pt[1] + add_, pt[2] + add_, pt[3] + add_, pt[4] + add_] END AS d, pt[5] + CASE WHEN doc_id % 31 = 0 THEN 1 ELSE 0 END AS total FROM p)
        SELECT row_id, 'missing id' AS violation FROM r WHERE id IS NULL UNION ALL SELECT row_id, 'missing publisher' FROM r WHERE coalesce(publisher, '') = ''
        UNION ALL SELECT row_id, 'missing title' FROM r WHERE coalesce(title, '') = '' UNION ALL SELECT row_id, 'missing priority' FROM r WHERE priority IS NULL
        UNION ALL SELECT row_id, 'source_url is not https' FROM r WHERE NOT starts_with(u, 'https://')
        UNION ALL SELECT row_id, 'content out of range' FROM r WHERE d[1] > 35 UNION ALL SELECT row_id, 'impact out of range' FROM r WHERE d[2] > 25
        UNION ALL SELECT row_id, 'relevance out of range' FROM r WHERE d[3] > 25 UNION ALL SELECT row_id, 'evidence out of range' FROM r WHERE d[4] > 15
        UNION ALL SELECT row_id, 'total is not the sum' FROM r WHERE list_sum(d) <> total""",
    "ledger_duplicates": f"WITH {b.LEDGER} SELECT 'id' AS kind, id AS value, count(*) AS n FROM ledger GROUP BY id HAVING n > 1 UNION ALL SELECT 'url', {_key('url')}, count(*) AS n FROM ledger GROUP BY 2 HAVING n > 1",
    "merge_ledger": f"""WITH {b.LEDGER}, k AS (SELECT *, {_key('url')} AS key FROM ledger), e AS (SELECT * FROM k WHERE doc_id % 3 = 0), a AS (SELECT * FROM k WHERE (doc_id % 3 <> 0 OR doc_id % 30 = 0) AND id NOT IN (SELECT id FROM e) AND key NOT IN (SELECT key FROM e))
        SELECT id, url, doc_id AS ordinal, 'existing' AS origin FROM e UNION ALL SELECT id, url, doc_id, 'addition' FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)""",
    "ledger_override_join": f"WITH {b.LEDGER} SELECT id, priority, title, CASE WHEN doc_id % 2 = 0 THEN length(content)::INT END AS archived_characters FROM ledger",
    "topic_normalize": f"WITH {_MIGRATED} SELECT article_id AS id, topic_to AS topic FROM migrated",
    "topic_migration_audit": f"WITH {_MIGRATED} SELECT * FROM migrated",
    "topic_summary": f"WITH {_MIGRATED} SELECT count(*) AS articles, count(DISTINCT topic_from) AS input_topics, count(DISTINCT topic_to) AS output_topics, count(*) FILTER (topic_to IS NULL) AS unknown FROM migrated",
    "classify_titles": f"""WITH {b.LEDGER} SELECT id, {_class("(title || ' ' || category)")} AS category, ({_points('category')})[5]::INT AS total FROM ledger""",
    "score_labels": f"""WITH {b.LEDGER} SELECT id, CASE WHEN score_total >= 78 THEN 'high' WHEN score_total >= 68 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN score_total >= 82 THEN 'must-read' WHEN score_total >= 74 THEN 'track' ELSE 'reference' END AS priority,
        floor(score_total / coalesce(score_scale, 100.0::DOUBLE) * 1000.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS percent, 'must-read' || lang AS label, CASE lang WHEN 'en' THEN 'middle' WHEN 'fr' THEN 'high' ELSE 'unknown' END AS confidence FROM ledger""",
    "change_status": f"""WITH {b.LEDGER} SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 11 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM ledger WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0""",
    "archive_index": f"WITH {b.LEDGER} SELECT id, publisher, doc_id, row_number() OVER (PARTITION BY publisher ORDER BY doc_id)::INT AS archive_index FROM ledger",
    "archive_directories": rf"WITH {b.LEDGER} SELECT id, lpad(doc_id::VARCHAR, greatest(3, length(doc_id::VARCHAR))::INT, '0') || '-' || regexp_replace(substr(regexp_replace(regexp_replace(title, '[^\p{{L}}\p{{N}}\p{{M}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 96), '-+$', '') AS directory FROM ledger",
    "archive_outcomes": f"WITH {_STATE} SELECT id, http::INT AS http, status, CASE WHEN http = 500 THEN '500,1000,2000' ELSE '' END AS waits FROM state",
    "resume_pending": f"WITH {_STATE}, {_WANTED} SELECT id, url FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.id = w.id AND s.url = w.url AND status = 'downloaded')",
    "retry_failed": f"WITH {_STATE}, {_WANTED} SELECT id, url FROM wanted WHERE id IN (SELECT id FROM state WHERE status = 'failed')",
    "status_summary": f"WITH {_STATE} SELECT status AS label, count(*) AS n FROM state GROUP BY 1 UNION ALL SELECT 'extraction:' || extraction, count(*) FROM state GROUP BY 1",
    "archive_audit": f"""WITH {b.LEDGER}, a AS (SELECT id, CASE WHEN doc_id % 41 <> 0 THEN publisher ELSE 'unknown' END AS publisher, {_canon('url')} AS url, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 5 <> 0 END AS verified FROM ledger)
        SELECT CASE WHEN grouping(publisher) = 1 THEN '*' ELSE publisher END AS publisher, count(*) AS articles, count(DISTINCT id) AS unique_ids, count(DISTINCT url) AS unique_urls, count(*) FILTER (verified) AS verified, count(*) FILTER (verified IS NOT TRUE) AS unverified FROM a GROUP BY ROLLUP (publisher)""",
    "id_set_equality": f"WITH {b.LEDGER} SELECT id, CASE WHEN doc_id % 50 = 0 THEN 'right' ELSE 'left' END AS only_in FROM ledger WHERE (doc_id % 50 = 0) <> (doc_id % 60 = 0)",
    "manifest": f"""WITH {b.LEDGER} SELECT doc_id, array_to_string(list_transform([id, publisher, title, published_at, priority, substr(content, 1, 80)], lambda c: '"' || replace(coalesce(c, ''), '"', '""') || '"'), ',') AS line FROM ledger""",
    "manifest_whole": f"""WITH {b.LEDGER} SELECT doc_id, array_to_string(list_transform([id, publisher, title, published_at, priority, content], lambda c: '"' || replace(coalesce(c, ''), '"', '""') || '"'), ',') AS line FROM ledger""",
    "create_if_missing": f"WITH {b.LEDGER} SELECT id, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'new' END AS body FROM ledger WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "upsert_latest": f"WITH {b.LEDGER} SELECT id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 >= 1 THEN (doc_id % 3)::INT ELSE 1 END AS updated_at, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 >= 1 THEN 0 ELSE length(content)::INT END AS characters FROM ledger",
    "safe_paths": f"WITH {b.LEDGER} SELECT id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AND doc_id % 3 < 2 AS safe FROM ledger",
    "queue_entries": f"WITH {_QUEUE} SELECT * FROM queue",
    "queue_counts": f"WITH {_QUEUE} SELECT count(*) AS total, count(*) FILTER (status <> 'complete') AS pending, count(*) FILTER (status = 'complete') AS complete, count(*) FILTER (status = 'invalid') AS invalid FROM queue",
    "queue_filter": f"WITH {_QUEUE} SELECT * FROM queue WHERE publisher = 'src3' AND archive_index BETWEEN 100 AND 600 AND source_language = 'en' AND status <> 'complete'",
    "translation_batches": f"""WITH RECURSIVE {_QUEUE}, q AS (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY archive_index) AS k FROM queue),
        f AS (SELECT publisher, id, k, 1::BIGINT AS batch, 1 AS n, source_characters::BIGINT AS used FROM q WHERE k = 1
              UNION ALL SELECT q.publisher, q.id, q.k, CASE WHEN f.n >= 10 OR f.used + q.source_characters > 20000 THEN f.batch + 1 ELSE f.batch END,
                     CASE WHEN f.n >= 10 OR f.used + q.source_characters > 20000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 10 OR f.used + q.source_characters > 20000 THEN q.source_characters ELSE f.used + q.source_characters END
              FROM f JOIN q ON q.publisher = f.publisher AND q.k = f.k + 1)
        SELECT publisher, id, batch FROM f""",
}
