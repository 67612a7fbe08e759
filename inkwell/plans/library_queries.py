"""Scenario libraries: built from a plan, checked with planted faults, ordered and projected."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkwell.operators import decisions, libraries
from inkwell.plans import bindings as b
from inkwell.scratch import Scratch

_EACH, _HOUSES = 25, 40


def _plan(spark, sf):
    """part as plans of 25 scenarios, in the order of keys within a brand."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    p = b.table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_type", i.alias("k"))
    k = F.col("p_partkey")
    source = lambda n: F.concat(F.lit("s"), n % _HOUSES)
    return p.select(
        F.concat("p_brand", F.lit("/"), F.floor(F.col("k") / _EACH)).alias("library"), (F.col("k") % _EACH).alias("ordinal"), F.concat(F.lit("用 AI "), "p_name").alias("title"), F.lit("short title").alias("short_title"), F.col("p_type").alias("category"),
        F.lit("risk").alias("risk"), F.concat(F.lit("focus"), k).alias("focus"), F.lit("orders").alias("inputs"), F.lit("refunds").alias("exception"), F.lit("plan").alias("output"), F.lit("margin").alias("kpi"), F.when(k % 2 == 0, "ops").alias("owner"),
        source(k).alias("research_id"), source(k + 1).alias("case_id"), F.when(k % 3 == 0, source(k + 2)).alias("secondary_id"), F.when(k % 19 == 0, "P2").alias("priority"),
    )


_PLAN = f"""p0 AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part),
    plan AS (SELECT p_brand || '/' || (k // {_EACH}) AS library, (k % {_EACH})::INT AS i, p_partkey AS key, p_name, p_type FROM p0),
    built AS (SELECT *, lpad((i + 1)::VARCHAR, 2, '0') AS number, CASE WHEN key % 19 = 0 THEN 'P2' WHEN i < 3 THEN 'P0' WHEN i < 18 THEN 'P1' WHEN i < 23 THEN 'P2' ELSE 'P3' END AS priority,
        's' || key % {_HOUSES} AS research, 's' || (key + 1) % {_HOUSES} AS case_, CASE WHEN key % 3 = 0 THEN 's' || (key + 2) % {_HOUSES} ELSE 's7' END AS second FROM plan)"""


def _sources(plan):
    """Forty sources of each library."""
    each = plan.select("library").distinct().select("library", F.explode(F.sequence(F.lit(0), F.lit(_HOUSES - 1))).alias("i"))
    i = F.col("i")
    return each.select(
        "library", "i", F.concat(F.lit("s"), i).alias("source_id"), F.concat(F.lit("source "), i).alias("title"), F.concat(F.lit("house"), i % 5).alias("publisher"), F.when(i % 4 == 0, libraries.VENDOR).otherwise("研究").alias("evidence_type"),
        F.lit("limits").alias("limitation"), F.when(i % 2 == 0, "/archive/x/source.md").otherwise("https://x.example/a").alias("url"), F.when(i % 3 == 0, "2026-05-01").alias("published_at"), F.concat(F.lit("fact "), i).alias("fact"), F.lit("p. 1").alias("locator"),
        F.when(i % 6 == 0, "legacy_reference").alias("evidence_window"), F.concat(F.lit("company"), i % 7).alias("company"), F.lit("summary").alias("case_summary"), F.when(i % 5 == 0, "客户案例").alias("case_type"), F.lit("caveat").alias("caveat"),
        F.when(i % 9 == 0, "国际").alias("market"), F.lit(None).cast("string").alias("basis"),
    )


def _once(spark, label, **rows):
    """These tables written once and read again: what follows reads them many times, and would make them anew each time."""
    scratch = Scratch(spark, label)
    return [scratch.table(r, name) for name, r in rows.items()]


def _built(spark, sf):
    plan = _plan(spark, sf)
    return libraries.built(plan, _sources(plan), "s7")


#: Faults that are planted in scenarios: column, faulty value, and the error that must be found; each in those of one place.
_FAULTS = [
    ("risk", "' '", "risk must be text"), ("title", "'AI title'", "title must start with 用 AI or 让 AI"), ("short_title", "'abc'", "short_title must have 4 to 14 characters"), ("number", "'1'", "number must have two digits"),
    ("red_line", "cast(null as boolean)", "red_line must be true or false"), ("problem", "array('a', 'b')", "problem must have 3 entries"), ("problem", "array('a', 'b', ' ')", "problem must not have empty entries"), ("ai_value", "cast(null as array<string>)", "ai_value must have 4 entries"),
    ("value", "5.5D", "value must be from 1 to 5"), ("feasibility", "cast(null as double)", "feasibility must be from 1 to 5"), ("x", "101", "x must be from 0 to 100"), ("y", "-1", "y must be from 0 to 100"), ("matrix_eligible", "cast(null as boolean)", "matrix_eligible must be true or false"),
    ("confidence", "named_struct('level', 'sure', 'reason', 'r')", "confidence needs a level and a reason"), ("human_handoff", "''", "human_handoff must be text"), ("evidence_window", "'old'", "evidence_window is unknown"), ("acceptance_metrics", "array('a')", "acceptance_metrics must have 3 entries"),
]


def _faulty(spark, sf):
    """Built libraries with one fault in each scenario from the 13th to the 23rd place on (no matrix rank there), and faults of libraries and sources."""
    plan = _plan(spark, sf)
    sources = _sources(plan)
    scenarios = libraries.built(plan, sources, "s7")
    at = (F.col("i") - 12) + 9 * F.length("library")
    for k, (column, value, _) in enumerate(_FAULTS):
        scenarios = scenarios.withColumn(column, F.when((F.col("i") >= 12) & (at % len(_FAULTS) == k), F.expr(value)).otherwise(F.col(column)))
    return plan, sources, scenarios


def _library_rows(scenarios):
    return scenarios.groupBy("library").agg(F.count("*").alias("scenario_count"), F.count_if(F.col("priority") == "P0").alias("p0_count")).select("library", F.lit("t").alias("title"), F.lit("e").alias("eyebrow"), F.lit("2026-08-24").alias("updated_at"), F.lit("j").alias("core_judgment"), "scenario_count", "p0_count")


def _errors(spark, sf):
    plan, sources, scenarios = _faulty(spark, sf)
    i = F.col("i")
    bad = sources.where(i != 39).withColumn("url", F.when(i == 1, "http://x.example").otherwise(F.col("url"))).withColumn("published_at", F.when(i == 3, "2026-02-30").otherwise(F.col("published_at"))).withColumn("limitation", F.when(i == 5, " ").otherwise(F.col("limitation")))
    scenarios, bad = _once(spark, "libraries", scenarios=scenarios, sources=bad)
    trials = libraries.pilots(scenarios).withColumn("scope", F.when(i == 1, "").otherwise(F.col("scope")))
    return libraries.errors(_library_rows(scenarios), scenarios, trials, bad)


_EXPECTED = f"""{_PLAN}, n AS (SELECT library, count(*) AS n, count(*) FILTER (priority = 'P0') AS p0, list_sort(list(i + 1) FILTER (i < 12 AND i >= 0)) AS ranks FROM built GROUP BY library),
    cases AS (SELECT library, i, 's' || (key + 1) % {_HOUSES} AS source_id, (key + 1) % {_HOUSES} AS c FROM built),
    homes AS (SELECT library, count(DISTINCT c % 7) AS homes FROM cases WHERE c % 9 <> 0 GROUP BY library),
    faults AS (SELECT unnest(range({len(_FAULTS)})) AS k, unnest([{', '.join(chr(39) + e + chr(39) for _, _, e in _FAULTS)}]) AS error),
    used AS (SELECT library, i, priority, unnest(list_distinct(CASE WHEN priority = 'P0' THEN [research, second, case_] ELSE [research, case_] END)) AS source_id FROM built),
    houses AS (SELECT library, i, count(DISTINCT substr(source_id, 2)::INT % 5) FILTER (source_id <> 's39') AS n FROM used WHERE priority = 'P0' GROUP BY ALL),
    firsts AS (SELECT library, i, row_number() OVER (PARTITION BY library ORDER BY i) AS place FROM built WHERE priority = 'P0')
    SELECT library, 'scenarios[' || i || ']' AS place, error FROM built JOIN faults ON i >= 12 AND (i - 12 + 9 * length(library)) % {len(_FAULTS)} = k
    UNION ALL SELECT library, 'scenarios[' || i || ']', 'P3 needs a red line' FROM built JOIN faults ON error LIKE 'red_line%' AND i >= 12 AND (i - 12 + 9 * length(library)) % {len(_FAULTS)} = k WHERE priority = 'P3'
    UNION ALL SELECT library, 'scenarios[' || i || ']', 'evidence_ids names an unknown source s39' FROM used WHERE source_id = 's39'
    UNION ALL SELECT library, 'scenarios[' || i || '].company_cases[0]', 'source_id names an unknown source s39' FROM cases WHERE source_id = 's39'
    UNION ALL SELECT library, 'scenarios[' || i || '].source_facts[' || x || ']', 'source_id names an unknown source s39' FROM built, (VALUES (0), (1)) v(x) WHERE CASE x WHEN 0 THEN research ELSE case_ END = 's39'
    UNION ALL SELECT library, 'scenarios[' || i || ']', 'P0 needs evidence of two publishers' FROM houses WHERE n < 2
    UNION ALL SELECT library, 'library', 'scenario_count must be that of 20 to 30 scenarios' FROM n WHERE n NOT BETWEEN 20 AND 30
    UNION ALL SELECT library, 'library', 'each matrix_rank from 1 to 12 once' FROM n WHERE n < 12
    UNION ALL SELECT n.library, 'library', 'two companies of the home market are needed' FROM n LEFT JOIN homes ON homes.library = n.library WHERE coalesce(homes, 0) < 2
    UNION ALL SELECT library, 'pilots[1]', 'scope must be text' FROM firsts WHERE place = 2
    UNION ALL SELECT library, 'sources[' || i || ']', e FROM n, (VALUES (1, 'url must be https or of the archive'), (3, 'published_at must be a date'), (5, 'limitation must be text')) v(i, e)"""


def _dated(spark, sf):
    plan = _plan(spark, sf)
    sources = _sources(plan)
    scenarios = libraries.built(plan, sources, "s7")
    dates = scenarios.select("library", "id", F.explode("evidence_ids").alias("source_id")).join(sources.select("library", "source_id", "published_at").hint("merge"), ["library", "source_id"])
    return scenarios.join(dates.groupBy("library", "id").agg(F.max("published_at").alias("latest")).hint("merge"), ["library", "id"], "left")


def _repeated(spark, sf):
    plan = _plan(spark, sf)
    sources, scenarios = _sources(plan), _built(spark, sf)
    return libraries.shared_ids(_library_rows(scenarios), scenarios.withColumn("id", F.when(F.col("i") == 20, "same").otherwise(F.col("id"))), sources.where("i < 4"))


_FILES = [("x/source.md",), ("a b/source.md",)]
_LOCAL = [("l", "s1", "/archive/x/source.md"), ("l", "s2", "/archive/x/../../etc"), ("l", "s3", "/archive/gone.md"), ("l", "s4", "/archive/a%20b/source.md"), ("l", "s5", "https://x.example/a"), ("l", "s6", "/archive/x/%2e%2e/x/source.md"), ("m", "s1", "/archive/%2e%2e/y")]


QUERIES = {
    "library_build": lambda s, sf: _built(s, sf).select(
        "library", "id", "number", "title", "priority", "total", "value", "feasibility", "x", "y", "matrix_rank", "red_line", F.col("confidence.level").alias("confidence"), "evidence_window", F.array_join("evidence_ids", ",").alias("evidence_ids"),
        F.get("problem", F.lit(0)).alias("problem"), "human_handoff", F.get("company_cases", F.lit(0)).getField("company").alias("company"), F.get("company_cases", F.lit(0)).getField("case_type").alias("case_type"), F.get("company_cases", F.lit(0)).getField("market").alias("market"),
    ),
    "library_pilots": lambda s, sf: libraries.pilots(_built(s, sf)).select("library", "id", "scenario_id", "label", "title"),
    "library_errors": _errors,
    "library_shared_ids": _repeated,
    "library_filter": lambda s, sf: libraries.filtered(_built(s, sf), "P1", "PROMO").groupBy("library").agg(F.count("*").alias("visible")),
    "library_by_date": lambda s, sf: libraries.ordered(_dated(s, sf), "date").select("library", "id", "latest", "place"),
    "library_by_number": lambda s, sf: libraries.ordered(_dated(s, sf)).select("library", "id", "place"),
    "scenario_ledger": lambda s, sf: libraries.scenario_ledger(_built(s, sf)).select("library", "id", "priority", F.to_json("source_facts").alias("source_facts"), F.to_json("company_cases").alias("company_cases")),
    "source_copies": lambda s, sf: (lambda src: libraries.archived(src, src.where("i % 4 != 3").select("library", "source_id", F.when(F.col("i") % 2 == 0, F.concat(F.lit("folder"), "i")).alias("local"))).select("library", "source_id", "copy", "local"))(_sources(_plan(s, sf))),
    "local_sources": lambda s, sf: libraries.local_copies(s.createDataFrame(_LOCAL, "library string, source_id string, url string"), s.createDataFrame(_FILES, "path string")),
}

_CARD = "CASE priority WHEN 'P0' THEN 84 WHEN 'P1' THEN 74 WHEN 'P2' THEN 60 ELSE 48 END"
_BY = lambda a, b_, c, d: f"CASE priority WHEN 'P0' THEN {a} WHEN 'P1' THEN {b_} WHEN 'P2' THEN {c} ELSE {d} END::DOUBLE"
_IDS = "CASE WHEN priority = 'P0' THEN list_filter([research, CASE WHEN second <> research THEN second END, CASE WHEN case_ <> research AND case_ <> second THEN case_ END], lambda x: x IS NOT NULL) ELSE [research, case_] END"
_PLACES = str([list(p) for p in decisions.POSITIONS])

ORACLES = {
    "library_build": f"""WITH {_PLAN}, c AS (SELECT *, (key + 1) % {_HOUSES} AS c, key % {_HOUSES} AS r, {_PLACES}[i + 1] AS xy FROM built)
        SELECT library, library || '-' || number AS id, number, '用 AI ' || p_name AS title, priority, {_CARD}::INT AS total, {_BY(5, 4.5, 4, 3.5)} AS value, {_BY(4.5, 4, 3.5, 1.5)} AS feasibility,
               coalesce(xy[1], 12 + (i * 17) % 76)::INT AS x, coalesce(xy[2], 18 + (i * 23) % 70)::INT AS y, CASE WHEN i < 12 THEN (i + 1)::INT END AS matrix_rank, priority = 'P3' AS red_line,
               CASE WHEN priority = 'P0' AND r % 4 <> 0 THEN 'high' ELSE 'middle' END AS confidence, CASE WHEN r % 6 = 0 THEN 'legacy_reference' ELSE 'current' END AS evidence_window, array_to_string({_IDS}, ',') AS evidence_ids,
               'focus' || key || '目前依赖人工经验和分散规则，响应慢且难以稳定复制。' AS problem,
               '当模型无法给出证据、触发“refunds”或动作会影响客户、员工、供应商、现金或合规时，由' || CASE WHEN key % 2 = 0 THEN 'ops' ELSE '具名业务负责人' END || '审批后再执行。' AS human_handoff,
               'company' || c % 7 AS company, CASE WHEN c % 5 = 0 THEN '客户案例' ELSE '公司披露' END AS case_type, CASE WHEN c % 9 = 0 THEN '国际' ELSE '中国' END AS market FROM c""",
    "library_pilots": f"""WITH {_PLAN}, f AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY i) AS place FROM built WHERE priority = 'P0')
        SELECT library, library || '-pilot-' || place AS id, library || '-' || number AS scenario_id, '优先启动 0' || place AS label, '用 AI ' || p_name AS title FROM f WHERE place <= 3""",
    "library_errors": f"WITH {_EXPECTED}",
    "library_shared_ids": f"WITH {_PLAN}, l AS (SELECT count(DISTINCT library) AS n FROM built) SELECT 'scenario' AS kind, 'same' AS id, count(*) AS n FROM built WHERE i = 20 HAVING n > 1 UNION ALL SELECT 'source', 's' || i, n FROM l, range(4) r(i) WHERE n > 1",
    "library_filter": f"WITH {_PLAN} SELECT library, count(*) AS visible FROM built WHERE priority = 'P1' AND p_type = 'PROMO' GROUP BY library",
    "library_by_date": f"""WITH {_PLAN}, u AS (SELECT library, number, i, unnest({_IDS}) AS s FROM built), d AS (SELECT library, number, i, max(CASE WHEN substr(s, 2)::INT % 3 = 0 THEN '2026-05-01' END) AS latest FROM u GROUP BY ALL)
        SELECT library, library || '-' || number AS id, latest, row_number() OVER (PARTITION BY library ORDER BY latest DESC NULLS LAST, i)::INT AS place FROM d""",
    "library_by_number": f"WITH {_PLAN} SELECT library, library || '-' || number AS id, (i + 1)::INT AS place FROM built",
    "scenario_ledger": f"""WITH {_PLAN}, c AS (SELECT *, (key + 1) % {_HOUSES} AS c, key % {_HOUSES} AS r FROM built)
        SELECT library, library || '-' || number AS id, priority, '[{{"source_id":"' || research || '","text":"fact ' || r || '","locator":"p. 1"}},{{"source_id":"' || case_ || '","text":"fact ' || c || '","locator":"p. 1"}}]' AS source_facts,
               '[{{"company":"company' || c % 7 || '","source_id":"' || case_ || '","market":"' || CASE WHEN c % 9 = 0 THEN '国际' ELSE '中国' END || '","caveat":"caveat"}}]' AS company_cases FROM c""",
    "source_copies": f"""WITH {_PLAN} SELECT library, 's' || i AS source_id, CASE WHEN i % 4 = 3 THEN 'missing' WHEN i % 2 = 0 THEN 'local' ELSE 'remote' END AS copy, CASE WHEN i % 4 <> 3 AND i % 2 = 0 THEN 'folder' || i END AS local
        FROM (SELECT DISTINCT library FROM built), range({_HOUSES}) r(i)""",
    "local_sources": "SELECT * FROM (VALUES ('l', 's2', '/archive/x/../../etc', 'leaves the archive'), ('l', 's3', '/archive/gone.md', 'no such file'), ('l', 's6', '/archive/x/%2e%2e/x/source.md', 'no such file'), ('m', 's1', '/archive/%2e%2e/y', 'leaves the archive')) v(library, source_id, url, error)",
}
