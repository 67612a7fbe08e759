"""Places in the order of a group, however large the group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.scratch import Scratch, parallelism


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with their ``place`` (from 0) in their ``group``, by ``order``; nulls come first, a null group is one.

    A window over a group would put all of it in one task. Here rows are range-partitioned by group and order
    and written with running numbers; the stretches of a group, one a partition at most, say by how much these are off.
    Rows that are equal in group and order take neighbouring places in any order.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    ordered = scratch.table(ranged.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    stretches = ordered.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = scratch.table(stretches.select("_part", "_group", (before - F.col("_first")).alias("_shift")), "shifts")
    held = ordered.join(shifts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return held.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"))
