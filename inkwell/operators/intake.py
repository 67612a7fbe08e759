"""Refresh of the ledger: records built from candidates, inspections and editorial overrides.

Every rule that stops a refresh is a row of ``problems``; ``records`` holds the candidates that
no rule stops, and ``required`` turns problems into a failing job for those who want that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import scores, text, urls
from inkwell.operators import ledger

#: Digest titles of the supported publishers (fixed values).
RADARS = {
    "BCG": "BCG Insight Radar · 2026-W31 · Static",
    "Anthropic": "Anthropic 最近半年洞察雷达 | 2026-08-02",
    "McKinsey": "McKinsey 最近半年洞察雷达 | 2026-08-02",
    "MIT": "MIT AI Management Insight Radar · 2026-08-04",
    "Bain": "Bain Six-Month Insight Radar · 2026-08-02",
}


def next_indexes(existing: DataFrame, group: str = "publisher", index: str = "archive_index", ordinal: str = "ordinal") -> DataFrame:
    """The index that each publisher has reached: rows without one count one on from what was reached before them.

    Each missing index adds one to the largest before it, so the end is the largest of an index
    plus the missing ones behind it, and of all missing ones.
    """
    behind = Window.partitionBy(group).orderBy(F.desc(ordinal)).rowsBetween(Window.unboundedPreceding, -1)
    missing = F.col(index).isNull().cast("int")
    rows = existing.withColumn("behind", F.coalesce(F.sum(missing).over(behind), F.lit(0)))
    return rows.groupBy(group).agg(F.greatest(F.max(F.col(index) + F.col("behind")), F.sum(missing)).cast("long").alias("last_index"))


def free_number(taken: Column, turn: Column) -> Column:
    """The ``turn``-th number from 1 on that is not in ``taken``."""
    return F.aggregate(F.array_sort(F.array_distinct(taken)), turn, lambda at, used: F.when(used <= at, at + 1).otherwise(at))


def _key(url: str) -> Column:
    return F.lower(urls.canonical(F.col(url)))


def _judged(candidates: DataFrame, inspections: DataFrame, overrides: DataFrame, existing: DataFrame, radars: dict[str, str]) -> DataFrame:
    """Included candidates with what is known of them, and the first rule that stops each."""
    rows = candidates.where("status = 'included'").withColumn("key", _key("url"))
    seen = inspections.groupBy(_key("url").alias("key")).agg(F.max_by("inspected", "inspected_title").alias("inspected"), F.max("inspected_title").alias("inspected_title"))
    titles = overrides.groupBy(_key("url").alias("key")).agg(F.max("title_zh").alias("title_zh"), F.max("title_original").alias("title_original"))
    known = existing.where("url is not null").select(_key("url").alias("key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(seen, "key", "left").join(titles, "key", "left").join(known, "key", "left")
    rows = rows.withColumn("verified", F.coalesce(F.col("inspected") == "verified", F.lit(False)))
    rows = rows.withColumn("title", F.when(F.col("verified"), F.col("inspected_title")).otherwise(F.col("title_original")))
    table = F.create_map(*[F.lit(x) for kv in radars.items() for x in kv])
    rows = rows.withColumn("radar_title", F.try_element_at(table, F.col("publisher")))
    turn = F.row_number().over(Window.partitionBy("key").orderBy("candidate_id"))
    rules = [
        (F.coalesce(F.col("known"), F.lit(False)) | (turn > 1), "known url"), (text.blank(F.col("title_zh")) == "", "no editorial title"),
        (text.blank(F.col("title")) == "", "no verified or editorial original title"), (F.col("radar_title").isNull(), "unsupported publisher"),
    ]
    return rows.withColumn("problem", F.coalesce(*[F.when(broken, F.lit(name)) for broken, name in rules]))


def problems(candidates: DataFrame, inspections: DataFrame, overrides: DataFrame, existing: DataFrame, radars: dict[str, str] = RADARS) -> DataFrame:
    """(candidate_id, url, problem): known or repeated URL, missing titles, unsupported publisher; the first of each candidate."""
    return _judged(candidates, inspections, overrides, existing, radars).where("problem is not null").select("candidate_id", "url", "problem")


def required(found: DataFrame) -> None:
    """Fails with the first problem, if there is one."""
    first = found.orderBy("candidate_id").head()
    if first:
        raise ValueError(f"{first.problem}: {first.url}")


def records(candidates: DataFrame, inspections: DataFrame, overrides: DataFrame, existing: DataFrame, radars: dict[str, str] = RADARS) -> DataFrame:
    """Ledger records of the candidates (candidate_id, url, publisher, status, reason, published_at) that no rule stops.

    Inspections are (url, inspected, inspected_title), overrides (url, title_zh, title_original),
    existing rows (id, publisher, url, archive_index, ordinal). The title is the inspected one
    only where the page was verified. Ids are publisher, ``refresh`` and the URL's slug; one that is in use, by
    an existing row or an earlier candidate, takes the least free suffix from -2 on.
    Indexes go on from where each publisher's stand, in the order of candidates.
    """
    rows = _judged(candidates, inspections, overrides, existing, radars).where("problem is null")
    house = F.regexp_replace(F.lower("publisher"), "[^a-z0-9]+", "-")
    rows = rows.withColumn("base", F.concat(house, F.lit("-refresh-"), urls.slug(urls.canonical(F.col("url")))))
    # An id in use takes the base itself (1) or, if it ends in a number, that number of the part before.
    ids = existing.where("id is not null").select("id").distinct()
    suffix = F.expr("try_cast(regexp_extract(id, '^(.*)-([1-9][0-9]*)$', 2) as bigint)")
    parts = F.array(F.struct(F.col("id").alias("base"), F.lit(1).cast("long").alias("n")), F.struct(F.regexp_extract("id", r"^(.*)-([1-9]\d*)$", 1).alias("base"), F.when(suffix > 1, suffix).alias("n")))
    used = ids.select(F.explode(parts).alias("u")).select("u.*").where("n is not null")
    used = used.join(rows.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.collect_set("n").alias("taken"))
    rows = rows.join(used, "base", "left")
    turn = F.row_number().over(Window.partitionBy("base").orderBy("candidate_id")).cast("long")
    number = free_number(F.coalesce("taken", F.array().cast("array<bigint>")), turn)
    rows = rows.withColumn("number", number).withColumn("id", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("number").cast("string"))))
    order = Window.partitionBy("publisher").orderBy("candidate_id")
    rows = rows.join(next_indexes(existing), "publisher", "left")
    said = F.concat("title", F.lit(" "), "title_zh", F.lit(" "), text.blank(F.col("reason")))
    rows = rows.withColumn("points", ledger.points(said)).withColumn("class", ledger.classify(said))
    return rows.select(
        "candidate_id", "id", "radar_title", "publisher", urls.canonical(F.col("url")).alias("source_url"), F.col("title").alias("title_original"), "title_zh",
        F.when(F.col("published_at") != "", F.col("published_at")).alias("published_at"), F.col("class.primary").alias("category"), F.col("class.domains").alias("domains"),
        *[F.col(f"points.{d}").alias(d) for d in scores.MAXIMA], F.col("points.total").alias("total"), scores.tier(F.col("points.total")).alias("tier"), scores.priority(F.col("points.total")).alias("priority"),
        F.when(F.col("verified"), "high").otherwise("middle").alias("confidence"), F.when(F.col("verified"), "official_page_verified").otherwise("official_index_verified").alias("basis"),
        (F.coalesce("last_index", F.lit(0)) + F.row_number().over(order)).cast("long").alias("archive_index"),
    )
