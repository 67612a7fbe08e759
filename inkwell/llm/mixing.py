"""Mixing sources to target weights by hash-threshold histograms (operator 3).

Every document has a 60-bit hash. Sizes are summed by source and hash bucket; the bucket
where a source's budget ends is refined by the next bits, level by level, until the budget's
threshold is one hash value. Documents are then kept by comparing hashes: nothing is sorted,
a hot source is reduced on the map side, and a larger budget's mix contains a smaller one's.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVEL_BITS, LEVELS = 60, 10, 3
#: Weights of the sources in order, repeating, and the most times a source may be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 50_000
#: Equal rows that are written out of one row at once.
RUN = 65_536


def plan_targets(sources: DataFrame, share: float = 1.0) -> DataFrame:
    """Targets of sources (key, source, source_size) by water-filling.

    A source's target is its weight times one common level, but at most MOST times its size;
    the level is the one at which the targets add up to ``share`` of all sizes. Sources come
    in code point order, null last. The table has one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    rows = rows.withColumn("room", F.row_number().over(by_room)).withColumn("level", (total * F.lit(share) - capped) / weights)
    level = F.min_by(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level")), F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("room"))).over(Window.partitionBy())
    return rows.withColumn("target", F.least(F.col("cap").cast("double"), level * F.col("weight"))).select("key", "source", "source_size", "weight", "target")


def _hash(seed: str, id_col: str):
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def _key(source_col: str):
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("null"))


def _small(plan: DataFrame):
    return F.broadcast if plan.count() <= BROADCAST_SOURCES else (lambda x: x)


def _refine(rows: DataFrame, budgets: DataFrame, small, scratch: Scratch, label: str) -> DataFrame:
    """Where each source's budget ends among ``rows`` (key, v, size, n): budgets (key, budget) with bucket, before, m and n.

    ``bucket`` is the first value v at which the running sum exceeds the budget (null: all fits),
    ``before`` the sum below it, m and n the size and the rows at it.
    """
    running = Window.partitionBy("key").orderBy("bucket")
    state = budgets.select("key", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(1, LEVELS + 1):
        shift = BITS - LEVEL_BITS * level
        inside = rows if level == 1 else rows.withColumn("prefix", F.shiftright("v", shift + LEVEL_BITS)).join(small(state.select("key", "prefix")), ["key", "prefix"], "left_semi")
        counts = inside.groupBy("key", F.shiftright("v", shift).alias("bucket")).agg(F.sum("size").alias("m"), F.sum("n").alias("n"))
        first = _boundary(state, counts.withColumn("upto", F.sum("m").over(running)))
        # A source all of which fits keeps a prefix that no hash has.
        state = scratch.table(first.select("key", "budget", F.coalesce("bucket", F.lit(1 << BITS)).alias("prefix"), F.coalesce("before", "below").alias("below")), f"{label}{level}")
    # A bucket of the last level holds a 2**-30 part of a source: its hashes are told apart one by one.
    inside = rows.withColumn("prefix", F.shiftright("v", BITS - LEVEL_BITS * LEVELS)).join(small(state.select("key", "prefix")), ["key", "prefix"], "left_semi")
    counts = inside.groupBy("key", F.col("v").alias("bucket")).agg(F.sum("size").alias("m"), F.sum("n").alias("n"))
    return _boundary(state, counts.withColumn("upto", F.sum("m").over(running)))


def _boundary(state: DataFrame, counts: DataFrame) -> DataFrame:
    """Each source's first bucket in which the running sum exceeds its budget; nulls where none does."""
    over = state.select("key", "budget", "below").join(counts, "key").where(F.col("below") + F.col("upto") > F.col("budget"))
    first = over.groupBy("key").agg(F.min(F.struct("bucket", "upto", "m", "n")).alias("b"))
    joined = state.join(first, "key", "left")
    return joined.select("key", "budget", "below", "b.bucket", (F.col("below") + F.col("b.upto") - F.col("b.m")).alias("before"), "b.m", "b.n")


def thresholds(docs: DataFrame, scratch: Scratch, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The documents' sizes (id, key, size, h), each source's plan (key, source_size, target, copies, threshold, tied), and ties.

    A document is taken once more where h < threshold. ``tied`` says that several rows share the
    hash at which the budget ends, for their ids are null or equal. Those rows are in ``ties``:
    (key, row, n, size, more), n equal rows of which ``more`` are taken once more. They are told
    apart by a hash of all their columns; of rows that are equal in all columns as many are
    taken as come nearest to the budget. None where no source is tied.
    """
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), source.alias("source"), _size(text).alias("size"), _hash(seed, id_col).alias("h"), _key(source_col).alias("key"))
    rows = scratch.table(rows, "sizes")
    sources = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = scratch.table(plan_targets(sources), "targets")
    small = _small(plan)
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("copies", base)
    budgets = plan.select("key", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"))
    slim = rows.where("size > 0").select("key", F.col("h").alias("v"), "size", F.lit(1).cast("long").alias("n"))
    ends = _refine(slim, budgets, small, scratch, "level")
    nearer = (F.col("before") + F.col("m") - F.col("budget")) < (F.col("budget") - F.col("before"))
    tied = F.coalesce(F.col("n") > 1, F.lit(False))
    # The document at the threshold goes to the nearer side; tied ones are told apart.
    threshold = F.coalesce(F.col("bucket") + F.when(tied, 0).otherwise(nearer.cast("long")), F.lit(1 << BITS))
    ends = scratch.table(ends.select("key", "budget", "before", threshold.alias("threshold"), tied.alias("tied")), "ends")
    plan = scratch.table(plan.join(ends, "key").select("key", "source_size", "target", "copies", "threshold", "tied", (F.col("budget") - F.col("before")).alias("rest")), "thresholds")
    if plan.where("tied").isEmpty():
        return rows, small(plan), None

    at = plan.where("tied").select("key", F.col("threshold").alias("v"), "rest")
    content = F.xxhash64(F.to_json(F.struct("*"))).bitwiseAND(F.lit((1 << BITS) - 1))
    packed = docs.select(F.struct("*").alias("row"), _key(source_col).alias("key"), _hash(seed, id_col).alias("v"), _size(text).alias("size"), content.alias("c"))
    groups = packed.where("size > 0").join(small(at), ["key", "v"]).groupBy("key", "c").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("row").alias("row"), F.first("rest").alias("budget"))
    groups = scratch.table(groups, "groups")
    ends = _refine(groups.select("key", F.col("c").alias("v"), (F.col("size") * F.col("n")).alias("size"), "n"), at.withColumnRenamed("rest", "budget"), small, scratch, "tie")
    ends = scratch.table(ends.select("key", "bucket", "before"), "tie_ends")
    left = F.col("budget") - F.col("before")
    near = F.least("n", F.ceil(left / F.col("size") - 0.5).cast("long"))
    more = F.when(F.col("bucket").isNull() | (F.col("c") < F.col("bucket")), F.col("n")).when(F.col("c") == F.col("bucket"), F.greatest(near, F.lit(0).cast("long"))).otherwise(0)
    ties = groups.join(small(ends), "key").select("key", "row", "n", "size", more.cast("long").alias("more"))
    return rows, small(plan), scratch.table(ties, "ties")


def _size(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _repeated(rows: DataFrame, times, *columns) -> DataFrame:
    """``columns`` of each row as often as ``times`` says, in runs of bounded size."""
    runs = rows.withColumn("times", times.cast("long")).where("times > 0")
    runs = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / RUN))).alias("run"))
    length = F.least(F.lit(RUN).cast("long"), F.col("times") - F.col("run") * RUN).cast("int")
    return runs.select("*", F.posexplode(F.array_repeat(F.lit(1), length)).alias("at", "one")).select(*columns)


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: id, size, source_size, target, copies and taken.

    Size is the number of words of the whole text (null: 0). Each document is taken
    floor(target / source size) times, and once more below its source's hash threshold; the
    document at the threshold goes to the nearer side. A null source is a source. Rows of null
    or equal ids share a hash; where a budget ends among them they are told apart by all their
    columns, and of wholly equal rows the number nearest to the budget is taken. An empty
    table gives no rows; other columns, whatever their names, are not carried.
    """
    rows, plan, ties = thresholds(docs, Scratch(docs.sparkSession, "mix"), seed, id_col, text_col, source_col)
    out = rows.join(plan, "key").select("id", "size", "source_size", "target", "tied", "h", "threshold", (F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).alias("copies"))
    if ties is not None:
        equal = ties.join(plan, "key").select(F.col("row").getField(id_col).alias("id"), "size", "source_size", "target", "copies", "n", "more")
        facts = ("id", "size", "source_size", "target")
        again = _repeated(equal, F.col("more"), *facts, (F.col("copies") + 1).alias("copies")).unionByName(_repeated(equal, F.col("n") - F.col("more"), *facts, "copies"))
        out = out.where(~(F.col("tied") & (F.col("h") == F.col("threshold")) & (F.col("size") > 0))).select(*facts, "copies").unionByName(again)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as many times as it is taken.

    Columns may have any names, those of this module's own included: a caller's row is one
    struct here. Nulls, equal ids, equal rows, blank texts (never in a budget, so taken only
    in whole copies of a source) and empty tables are as in ``mix``.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    _, plan, ties = thresholds(docs, scratch, seed, id_col, text_col, source_col)
    scratch.drop("sizes", "groups")  # what is left has a row a source, or is taken
    packed = docs.select(F.struct("*").alias("row"), _key(source_col).alias("key"), _hash(seed, id_col).alias("h"), *([_size(F.col(f"`{text_col}`").cast("string")).alias("size")] if ties is not None else []))
    joined = packed.join(plan, "key").withColumn("times", F.col("copies") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0))
    if ties is not None:
        joined = joined.where(~(F.col("tied") & (F.col("h") == F.col("threshold")) & (F.col("size") > 0)))
    out = joined.select("row", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("row.*")
    if ties is not None:
        out = out.unionByName(_repeated(ties.join(plan.select("key", "copies"), "key"), F.col("n") * F.col("copies") + F.col("more"), "row").select("row.*"))
    return out
