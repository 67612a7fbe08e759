"""Translation checks: headings, links, numbers, paragraphs, language and length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text

COVERAGE, RATIO, CHUNK_RATIO, SHORT = 0.8, 0.12, 0.05, 0.25


def verify(pairs: DataFrame, ratio: float = RATIO, drop_urls: bool = False, keep: Sequence[str | Column] = ()) -> DataFrame:
    """Measurements, errors and warnings of each (id, source, translation), and what ``keep`` names of its row."""
    s, t = F.col("source"), F.col("translation")
    plain = lambda xs: F.transform(xs, lambda x: F.regexp_replace(x, "[%‰]$", ""))
    rows = pairs.select(
        "id", *keep, text.heading_count(s).alias("source_headings"), text.heading_count(t).alias("headings"),
        text.urls(s).alias("source_urls"), text.urls(t).alias("urls"), plain(text.numbers(s)).alias("source_numbers"), plain(text.numbers(t)).alias("numbers"),
        text.paragraph_count(s).alias("source_paragraphs"), text.paragraph_count(t).alias("paragraphs"),
        text.han_ratio(t, drop_urls).alias("han_ratio"), F.length(text.blank(s)).alias("source_length"), F.length(text.blank(t)).alias("length"),
    )
    rows = _counted(rows, {"missing_urls": ("source_urls", "urls"), "missing_numbers": ("source_numbers", "numbers")})
    least = F.greatest(F.lit(1), F.floor(F.col("source_paragraphs") * COVERAGE).cast("int"))
    rules = {
        "headings": F.col("headings") < F.col("source_headings"), "urls": F.size("missing_urls") > 0, "numbers": F.size("missing_numbers") > 0,
        "paragraphs": F.col("paragraphs") < least, "language": F.col("han_ratio") < ratio,
    }
    errors = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.withColumn("errors", errors).withColumn("short", F.col("length") < SHORT * F.col("source_length")).withColumn("ok", F.size("errors") == 0)


def _counted(rows: DataFrame, differences: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with the multiset difference of two array columns under each name, in place of the arrays.

    One Arrow pass counts each array once; as a column expression the arrays would be made
    again for each of their values.
    """
    gone = {c for pair in differences.values() for c in pair}
    kept = [f for f in rows.schema if f.name not in gone]
    at = {c: k for k, c in enumerate(rows.columns)}
    short = pa.list_(pa.struct([("value", pa.string()), ("required", pa.int32()), ("actual", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for required, actual in differences.values():
                lists = []
                for mine, theirs in zip(batch.column(at[required]).to_pylist(), batch.column(at[actual]).to_pylist(), strict=True):
                    need, have = Counter(mine), Counter(theirs)
                    lists.append([{"value": v, "required": n, "actual": have[v]} for v, n in sorted(need.items()) if have[v] < n])
                made.append(pa.array(lists, short))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[f.name]) for f in kept), *made], [*(f.name for f in kept), *differences])

    given = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, ", ".join([given, *(f"{n} array<struct<value:string,required:int,actual:int>>" for n in differences)]))


def verdicts(checked: DataFrame) -> DataFrame:
    failed = checked.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    return failed.unionByName(checked.agg(F.lit("passed").alias("error"), F.count_if(F.col("ok")).alias("n")))


def altered(pairs: DataFrame, extract) -> DataFrame:
    """Rows of (id, value, required, actual) that the translation lacks, by counts on both sides."""
    count = lambda c, n: pairs.select("id", F.explode(extract(F.col(c))).alias("value")).groupBy("id", "value").agg(F.count("*").alias(n))
    both = count("source", "required").join(count("translation", "actual"), ["id", "value"], "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0))).where("actual < required")


def missing_forms(pairs: DataFrame) -> DataFrame:
    """Numbers that a translation lacks, without their rate signs: value, its last form in the source, and the counts."""

    def counted(col: str, n: str) -> DataFrame:
        each = pairs.select("id", F.posexplode(text.numbers(F.col(col))).alias("at", "form")).withColumn("value", F.regexp_replace("form", "[%‰]$", ""))
        return each.groupBy("id", "value").agg(F.count("*").alias(n), F.max_by("form", "at").alias("form"))

    both = counted("source", "required").join(counted("translation", "actual").drop("form"), ["id", "value"], "left")
    return both.withColumn("actual", F.coalesce("actual", F.lit(0))).where("actual < required").select("id", "value", "form", "required", "actual")
