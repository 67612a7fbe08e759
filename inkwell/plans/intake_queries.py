"""Queries on refreshes and merges by all of their rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import scores, urls
from inkwell.operators import intake, ledger
from inkwell.plans import bindings as b
from inkwell.plans.ledger_queries import _canon, _class, _key, _points, _slug

_HOUSES = [*intake.RADARS, "Other"]
_PAGE_HOUSE = "CASE page_id % 6 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_HOUSES)) + " END"


def _pages(spark, sf):
    i = F.col("page_id")
    house = F.element_at(F.array(*map(F.lit, _HOUSES)), (i % 6 + 1).cast("int"))
    base = F.concat(F.lower(house), F.lit("-refresh-"), urls.slug(urls.canonical(F.col("url"))))
    return b.table(spark, sf, "pages").select("page_id", "url", house.alias("publisher"), base.alias("base"))


def _inputs(spark, sf):
    """pages as candidates, inspections, overrides and existing rows, faults and used ids among them."""
    p, i = _pages(spark, sf), F.col("page_id")
    candidates = p.select(i.alias("candidate_id"), "url", "publisher", F.when(i % 7 == 0, "excluded").otherwise("included").alias("status"), F.when(i % 5 == 0, "a survey of risk").alias("reason"), F.when(i % 3 == 0, "2026-08-01").when(i % 3 == 1, "").alias("published_at"))
    inspections = p.where(i % 3 != 0).select("url", F.when(i % 3 == 1, "verified").otherwise("blocked").alias("inspected"), F.concat(F.lit("Inspected agent "), i).alias("inspected_title"))
    overrides = p.where(i % 11 != 0).select("url", F.concat(F.lit("增长 "), i).alias("title_zh"), F.when(i % 4 != 0, F.concat(F.lit("Original cloud "), i)).alias("title_original"))
    none = F.lit(None)
    existing = p.where(i % 13 == 0).select(F.concat(F.lit("old-"), i).alias("id"), "publisher", "url", F.when(i % 26 != 0, i % 9).cast("int").alias("archive_index"), i.alias("ordinal"))
    existing = existing.unionByName(p.where(i % 17 == 3).select(F.col("base").alias("id"), F.lit("BCG").alias("publisher"), none.cast("string").alias("url"), none.cast("int").alias("archive_index"), i.alias("ordinal")))
    existing = existing.unionByName(p.where(i % 34 == 3).select(F.concat("base", F.lit("-2")).alias("id"), F.lit("MIT").alias("publisher"), none.cast("string").alias("url"), F.lit(40).alias("archive_index"), i.alias("ordinal")))
    return candidates, inspections, overrides, existing


_INPUTS = f"""p0 AS (SELECT page_id, url, {_PAGE_HOUSE} AS publisher, {_canon('url')} AS canon FROM pages),
    p AS (SELECT *, lower(canon) AS key, lower(publisher) || '-refresh-' || {_slug('canon')} AS base FROM p0),
    seen AS (SELECT key, max('Inspected agent ' || page_id) AS inspected_title, arg_max(page_id % 3 = 1, 'Inspected agent ' || page_id) AS verified FROM p WHERE page_id % 3 <> 0 GROUP BY key),
    titles AS (SELECT key, max('增长 ' || page_id) AS title_zh, max(CASE WHEN page_id % 4 <> 0 THEN 'Original cloud ' || page_id END) AS title_original FROM p WHERE page_id % 11 <> 0 GROUP BY key),
    existing AS (SELECT 'old-' || page_id AS id, publisher, key, CASE WHEN page_id % 26 <> 0 THEN page_id % 9 END AS archive_index, page_id AS ordinal FROM p WHERE page_id % 13 = 0
        UNION ALL SELECT base, 'BCG', NULL, NULL, page_id FROM p WHERE page_id % 17 = 3 UNION ALL SELECT base || '-2', 'MIT', NULL, 40, page_id FROM p WHERE page_id % 34 = 3),
    j AS (SELECT p.*, coalesce(verified, FALSE) AS verified, title_zh, CASE WHEN coalesce(verified, FALSE) THEN inspected_title ELSE title_original END AS title,
                 p.key IN (SELECT key FROM existing WHERE key IS NOT NULL) OR row_number() OVER (PARTITION BY p.key ORDER BY page_id) > 1 AS known
          FROM p LEFT JOIN seen ON seen.key = p.key LEFT JOIN titles ON titles.key = p.key WHERE page_id % 7 <> 0),
    judged AS (SELECT *, CASE WHEN known THEN 'known url' WHEN coalesce(title_zh, '') = '' THEN 'no editorial title' WHEN coalesce(title, '') = '' THEN 'no verified or editorial original title'
                              WHEN publisher = 'Other' THEN 'unsupported publisher' END AS problem FROM j)"""
_RADAR = "CASE h.publisher " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in intake.RADARS.items()) + " END"
_DOMAINS = "CASE " + " ".join(f"WHEN regexp_matches(said, '{pattern}', 'i') THEN {domains}" for pattern, _, domains in ledger.RULES) + f" ELSE {ledger.DEFAULT[1]} END"


def _additions(spark, sf):
    """The ledger's rows as an old part and additions that repeat ids and URLs, or lack them."""
    i = F.col("doc_id")
    rows = b.ledger(spark, sf)
    old = rows.where(i % 3 == 0).select("id", F.when(i % 30 != 0, F.col("url")).alias("url"), i.alias("ordinal"))
    new = rows.where((i % 3 != 0) | (i % 15 == 0)).select(
        F.when(i % 7 == 1, F.format_string("doc-%06d", i - i % 70)).when(i % 31 != 5, F.col("id")).alias("id"), F.when(i % 11 != 2, F.col("url")).alias("url"), i.alias("ordinal")
    )
    return ledger.merge(old, new)


QUERIES = {
    "intake_records": lambda s, sf: intake.records(*_inputs(s, sf)).withColumn("domains", F.array_join("domains", "|")),
    "intake_problems": lambda s, sf: intake.problems(*_inputs(s, sf)),
    "next_indexes": lambda s, sf: intake.next_indexes(_inputs(s, sf)[3]),
    "merge_ledger_repeats": _additions,
    "change_status_nulls": lambda s, sf: ledger.change_status(
        b.ledger(s, sf).where("doc_id % 5 != 0").select("id", F.when(F.col("doc_id") % 3 != 0, F.col("title")).alias("fingerprint")), b.ledger(s, sf).where("doc_id % 7 != 0").select("id", F.when(F.col("doc_id") % 6 != 0, F.col("title")).alias("fingerprint"))
    ),
}

ORACLES = {
    "intake_problems": f"WITH {_INPUTS} SELECT page_id AS candidate_id, url, problem FROM judged WHERE problem IS NOT NULL",
    "next_indexes": f"""WITH RECURSIVE {_INPUTS}, o AS (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY ordinal) AS k FROM existing),
        f AS (SELECT publisher, k, greatest(0, coalesce(archive_index, 1)) AS c FROM o WHERE k = 1 UNION ALL SELECT o.publisher, o.k, greatest(f.c, coalesce(archive_index, f.c + 1)) FROM f JOIN o ON o.publisher = f.publisher AND o.k = f.k + 1)
        SELECT publisher, max(c)::BIGINT AS last_index FROM f GROUP BY publisher""",
    "intake_records": f"""WITH {_INPUTS}, lasts AS (SELECT publisher, greatest(coalesce(max(archive_index + behind), 0), count(*) FILTER (archive_index IS NULL)) AS last_index FROM
            (SELECT *, count(*) FILTER (archive_index IS NULL) OVER (PARTITION BY publisher ORDER BY ordinal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM existing) GROUP BY publisher),
        used AS (SELECT DISTINCT id AS base, 1 AS n FROM existing UNION SELECT regexp_extract(id, '^(.*)-([0-9]+)$', 1), regexp_extract(id, '-([0-9]+)$', 1)::INT FROM existing WHERE regexp_matches(id, '-[1-9][0-9]*$') AND NOT regexp_matches(id, '-1$')),
        taken AS (SELECT base, list(n) AS taken FROM used GROUP BY base),
        g AS (SELECT g0.*, coalesce(taken, []) AS taken, row_number() OVER (PARTITION BY g0.base ORDER BY page_id) AS turn, title || ' ' || title_zh || ' ' || CASE WHEN page_id % 5 = 0 THEN 'a survey of risk' ELSE '' END AS said FROM judged g0 LEFT JOIN taken t ON t.base = g0.base WHERE problem IS NULL),
        h AS (SELECT *, list_filter(range(1, turn + len(taken) + 1), lambda x: NOT list_contains(taken, x))[turn] AS number, {_points('said')} AS pt FROM g)
        SELECT page_id AS candidate_id, CASE WHEN number = 1 THEN base ELSE base || '-' || number END AS id, {_RADAR} AS radar_title, h.publisher, canon AS source_url, title AS title_original, title_zh,
               CASE WHEN page_id % 3 = 0 THEN '2026-08-01' END AS published_at, {_class('said')} AS category, array_to_string({_DOMAINS}, '|') AS domains,
               {', '.join(f'pt[{k}]::INT AS {d}' for k, d in enumerate(scores.MAXIMA, 1))}, pt[5]::INT AS total, CASE WHEN pt[5] >= 78 THEN 'high' WHEN pt[5] >= 68 THEN 'medium' ELSE 'low' END AS tier,
               CASE WHEN pt[5] >= 82 THEN 'must-read' WHEN pt[5] >= 74 THEN 'track' ELSE 'reference' END AS priority, CASE WHEN verified THEN 'high' ELSE 'middle' END AS confidence,
               CASE WHEN verified THEN 'official_page_verified' ELSE 'official_index_verified' END AS basis, (coalesce(last_index, 0) + row_number() OVER (PARTITION BY h.publisher ORDER BY page_id))::BIGINT AS archive_index
        FROM h LEFT JOIN lasts ON lasts.publisher = h.publisher""",
    "merge_ledger_repeats": f"""WITH {b.LEDGER}, e AS (SELECT id, CASE WHEN doc_id % 30 <> 0 THEN url END AS url, doc_id FROM ledger WHERE doc_id % 3 = 0),
        a AS (SELECT CASE WHEN doc_id % 7 = 1 THEN 'doc-' || lpad((doc_id - doc_id % 70)::VARCHAR, 6, '0') WHEN doc_id % 31 <> 5 THEN id END AS id, CASE WHEN doc_id % 11 <> 2 THEN url END AS url, doc_id FROM ledger WHERE doc_id % 3 <> 0 OR doc_id % 15 = 0),
        k AS (SELECT *, {_key('url')} AS key FROM a WHERE (id IS NULL OR id NOT IN (SELECT id FROM e)) AND (url IS NULL OR {_key('url')} NOT IN (SELECT {_key('url')} FROM e WHERE url IS NOT NULL))),
        x AS (SELECT * FROM k QUALIFY id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1), y AS (SELECT * FROM x QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY doc_id) = 1)
        SELECT id, url, doc_id AS ordinal, 'existing' AS origin FROM e UNION ALL SELECT id, url, doc_id, 'addition' FROM y""",
    "change_status_nulls": f"""WITH {b.LEDGER} SELECT id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 3 <> 0 OR doc_id % 6 = 0 THEN 'unchanged' ELSE 'changed' END AS change FROM ledger WHERE doc_id % 5 <> 0 OR doc_id % 7 <> 0""",
}
