"""Lists: filters, facets, sorting with nulls last, paging, address parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import scores, text


def browse(rows: DataFrame, publisher: str = "", year: str = "", category: str = "", priority: str = "", keyword: str = "") -> DataFrame:
    """Empty filters match all; the keyword is looked for in titles, publisher and category, without case."""
    out = rows
    for col, value in (("publisher", publisher), ("category", category), ("priority", priority)):
        if value:
            out = out.where(F.col(col) == value)
    if year:
        out = out.where(F.col("published_at").startswith(year))
    if keyword:
        hay = F.lower(F.concat_ws(" ", *[text.blank(F.col(c)) for c in ("title", "publisher", "category")]))
        out = out.where(hay.contains(keyword.strip().lower()))
    return out


def ordered(rows: DataFrame, mode: str) -> list:
    """Sort columns: by date or by score, both falling with nulls last, then by id."""
    date, score = F.desc_nulls_last("published_at"), scores.normalized(F.col("score_total"), F.col("score_scale")).desc_nulls_last()
    if mode not in ("date", "score"):
        raise ValueError(f"unknown sort mode {mode}")
    return [date, score, F.asc("id")] if mode == "date" else [score, date, F.asc("id")]


def page(rows: DataFrame, order: list, number: int, size: int = 30) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values that aren't empty, with counts."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return rows.select(pairs).select("p.*").where("coalesce(value, '') != ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
