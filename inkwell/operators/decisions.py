"""Ranked scenario libraries: scorecards, constraints, ordering, overlays, pilots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import scores

#: Most points of each dimension, and the points of each priority's scorecard (fixed values).
MAXIMA = {"business_value": 30, "process_fit": 20, "readiness": 15, "evidence": 15, "risk_control": 20}
SCORECARDS = {"P0": (26, 18, 13, 13, 14), "P1": (23, 15, 11, 11, 14), "P2": (19, 12, 9, 9, 11), "P3": (22, 8, 6, 5, 7)}
POSITIONS = [(88, 12), (68, 16), (82, 30), (58, 36), (42, 24), (28, 12), (48, 46), (38, 58), (25, 42), (18, 66), (10, 82), (8, 32)]
DIMENSIONS = list(MAXIMA)


def build(rows: DataFrame, group: str = "library", ordinal: str = "ordinal") -> DataFrame:
    """Scenarios from their order: number, priority, scorecard, rank and place in the matrix."""
    i = F.row_number().over(Window.partitionBy(group).orderBy(ordinal)) - 1
    out = rows.withColumn("i", i).withColumn("number", F.format_string("%02d", F.col("i") + 1))
    out = out.withColumn("priority", F.when(F.col("i") < 3, "P0").when(F.col("i") < 18, "P1").when(F.col("i") < 23, "P2").otherwise("P3"))
    cards = F.create_map(*[x for p, values in SCORECARDS.items() for x in (F.lit(p), F.array(*map(F.lit, values)))])
    for k, name in enumerate(DIMENSIONS):
        out = out.withColumn(name, F.element_at(cards, F.col("priority"))[k])
    out = out.withColumn("total", reduce(lambda a, b: a + b, map(F.col, DIMENSIONS))).withColumn("red_line", F.col("priority") == "P3")
    at = lambda k: F.get(F.array(*[F.lit(p[k]) for p in POSITIONS]), F.col("i"))
    out = out.withColumn("matrix_rank", F.when(F.col("i") < 12, F.col("i") + 1))
    out = out.withColumn("x", F.coalesce(at(0), 12 + (F.col("i") * 17) % 76)).withColumn("y", F.coalesce(at(1), 18 + (F.col("i") * 23) % 70))
    value = F.when(F.col("priority") == "P0", 5.0).when(F.col("priority") == "P1", 4.5).when(F.col("priority") == "P2", 4.0).otherwise(3.5)
    return out.withColumn("value", value)


def gate(priority: Column, total: Column, red_line: Column, prerequisite: Column) -> Column:
    """Whether a scorecard fits its priority."""
    some = F.trim(F.coalesce(prerequisite, F.lit(""))) != ""
    return (
        F.when(priority == "P0", (total >= 80) & ~red_line).when(priority == "P1", total.between(65, 79) & ~red_line)
        .when(priority == "P2", (total >= 50) & ~red_line & ((total <= 64) | some)).when(priority == "P3", red_line).otherwise(False)
    )


def violations(scenarios: DataFrame) -> DataFrame:
    """One row per broken rule of a scenario; all are reported."""
    total = reduce(lambda a, b: a + b, map(F.col, DIMENSIONS))
    rules = [(~F.coalesce(F.col(d).between(0, m), F.lit(False)), f"{d} out of range") for d, m in MAXIMA.items()]
    rules += [
        (~F.coalesce(F.col("total") == total, F.lit(False)), "total is not the sum"),
        (~gate(F.col("priority"), F.col("total"), F.col("red_line"), F.col("prerequisite")), "scorecard does not fit the priority"),
        (~F.coalesce(F.col("number").rlike(r"^\d{2}$"), F.lit(False)), "number must have two digits"),
        (~F.coalesce(F.col("title").rlike("^(用 AI|让 AI)"), F.lit(False)), "title must start with 用 AI or 让 AI"),
        (~F.length("short_title").between(4, 14), "short title must have 4 to 14 characters"),
        (~F.coalesce(F.col("x").between(0, 100) & F.col("y").between(0, 100), F.lit(False)), "matrix place out of range"),
        (F.col("matrix_rank").isNotNull() & ~F.col("matrix_rank").between(1, 12), "matrix rank out of range"),
        (F.col("matrix_rank").isNotNull() & F.col("red_line"), "ranked scenario has a red line"),
        (F.size("evidence_ids") == 0, "no evidence"),
    ]
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, name in rules]))
    return scenarios.select("id", F.explode(found).alias("violation"))


def evidence(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, source_id, publisher, published_at); a source that isn't there has nulls."""
    used = scenarios.select("id", F.explode("evidence_ids").alias("source_id"))
    return used.join(sources, "source_id", "left")


def unknown_evidence(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    return scenarios.select("id", F.explode("evidence_ids").alias("source_id")).join(sources, "source_id", "left_anti")


def narrow_evidence(scenarios: DataFrame, sources: DataFrame, least: int = 2) -> DataFrame:
    """P0 scenarios whose evidence has fewer than ``least`` publishers."""
    rows = scenarios.where("priority = 'P0'").select("id", F.explode("evidence_ids").alias("source_id")).join(sources, "source_id", "left")
    return rows.groupBy("id").agg(F.count_distinct("publisher").alias("publishers")).where(F.col("publishers") < least)


def latest_dates(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    return evidence(scenarios, sources).groupBy("id").agg(F.max(F.try_to_timestamp("published_at")).cast("date").alias("latest"))


def ranked(scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    """By total, evidence points, latest date (null last), then id."""
    rows = scenarios.join(latest_dates(scenarios, sources), "id", "left")
    order = Window.partitionBy("library").orderBy(F.desc("total"), F.desc("evidence"), F.desc_nulls_last("latest"), "id")
    return rows.withColumn("rank", F.row_number().over(order))


def pilots(pilot: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each pilot's scenario by id, else the P0 scenario at the pilot's position."""
    by_id = scenarios.select(F.col("library"), F.col("id").alias("scenario_id"), F.col("title").alias("by_id"))
    first = scenarios.where("priority = 'P0'").withColumn("position", F.row_number().over(Window.partitionBy("library").orderBy("number")))
    by_place = first.select("library", "position", F.col("id").alias("place_id"), F.col("title").alias("by_place"))
    rows = pilot.withColumn("position", F.row_number().over(Window.partitionBy("library").orderBy("pilot_id")))
    rows = rows.join(by_id, ["library", "scenario_id"], "left").join(by_place, ["library", "position"], "left")
    known = F.col("by_id").isNotNull()
    return rows.select("library", "pilot_id", F.when(known, F.col("scenario_id")).otherwise(F.col("place_id")).alias("scenario"), F.coalesce("by_id", "by_place").alias("title"), known.alias("explicit"))


def overlay(base: DataFrame, extra: DataFrame, default_market: str = "国际") -> DataFrame:
    """Cases of an overlay after those of the base; a case without a market gets the default."""
    more = extra.select("id", F.col("cases").alias("more"))
    joined = base.join(more, "id", "left")
    empty = F.array().cast("array<struct<company:string,market:string>>")
    cases = F.concat(F.coalesce("cases", empty), F.coalesce("more", empty))
    return joined.withColumn("cases", F.transform(cases, lambda c: F.struct(c.company.alias("company"), F.coalesce(c.market, F.lit(default_market)).alias("market")))).drop("more")


def source_violations(sources: DataFrame) -> DataFrame:
    rules = {
        "url": ~scores.source_url(F.col("url")), "date": F.col("published_at").isNotNull() & ~scores.strict_date(F.col("published_at")),
        "repeated id": F.count("*").over(Window.partitionBy("source_id")) > 1,
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return sources.withColumn("v", found).select("source_id", F.explode("v").alias("violation"))


def library_violations(scenarios: DataFrame, cases: DataFrame, ranks: int = 12, markets: int = 2, home: str = "中国") -> DataFrame:
    """Rules on whole libraries: 20 to 30 scenarios, each rank once, enough companies of the home market."""
    whole = scenarios.groupBy("library").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("matrix_rank")).alias("found"))
    homes = cases.where(F.col("market") == home).groupBy("library").agg(F.count_distinct("company").alias("companies"))
    rows = whole.join(homes, "library", "left")
    rules = {
        "20 to 30 scenarios": ~F.col("n").between(20, 30),
        "each rank once": F.col("found") != F.sequence(F.lit(1), F.lit(ranks)),
        "companies of the home market": F.coalesce("companies", F.lit(0)) < markets,
    }
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select("library", F.explode(broken).alias("violation"))
