"""Column functions on scores, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most points of each dimension (fixed values).
MAXIMA = {"content": 35, "impact": 25, "relevance": 25, "evidence": 15}


def normalized(total: Column, scale: Column) -> Column:
    """Score in percent with one decimal, halves rounded up; null where it can't be said."""
    scale = F.coalesce(scale, F.lit(100.0))
    return F.when(scale > 0, F.floor(total / scale * 1000.0 + 0.5) / 10.0)


def tier(total: Column) -> Column:
    return F.when(total >= 78, "high").when(total >= 68, "medium").otherwise("low")


def priority(total: Column, must: float = 82, track: float = 74) -> Column:
    return F.when(total >= must, "must-read").when(total >= track, "track").otherwise("reference")


def priority_label(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\s+", "-")


def confidence_label(value: Column) -> Column:
    """First of high, middle, medium, low; medium counts as middle; else unknown."""
    found = F.lower(F.regexp_extract(F.coalesce(value, F.lit("")), r"(?i)\b(high|middle|medium|low)\b", 1))
    return F.when(found == "", "unknown").when(found == "medium", "middle").otherwise(found)


def labelled_dimensions(text: Column) -> Column:
    """Four labelled points, or null unless all are there."""
    names = {"content": "CV|Content", "impact": "IB|Impact", "relevance": "SR|Relevance", "evidence": "ES|Evidence"}
    points = {k: F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i)(?:{v})\s*(\d+)"), F.lit(1)), F.lit(1)).cast("int") for k, v in names.items()}
    whole = F.lit(True)
    for p in points.values():
        whole = whole & p.isNotNull()
    return F.when(whole, F.struct(*[p.alias(k) for k, p in points.items()]))


def ordered_dimensions(text: Column) -> Column:
    """Four points given as n/35, n/25, n/25, n/15, or null if there are fewer."""
    found = F.regexp_extract_all(text, F.lit(r"(\d+)\s*/\s*(?:35|25|15)"), F.lit(1))
    return F.when(F.size(found) >= 4, F.struct(*[F.get(found, F.lit(i)).cast("int").alias(k) for i, k in enumerate(MAXIMA)]))


def strict_date(value: Column) -> Column:
    """The text is a real YYYY-MM-DD date."""
    return value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(F.try_to_date(value, "yyyy-MM-dd"), "yyyy-MM-dd") == value, F.lit(False))


def source_url(value: Column) -> Column:
    return F.coalesce(value.rlike("^https://[^/]+") | value.startswith("/archive/"), F.lit(False))
