"""A search index in segments: documents are added, replaced and deleted without writing it anew.

A segment is one batch of changes, a folder in each of four Parquet tables: the batch's postings, its
documents, the earlier versions that it makes stale, and its share of the corpus statistics, which is
written last and makes the segment count. A query reads the postings of its own tokens in all segments
and leaves out what is stale. ``merged`` writes the live rows as the one segment of a new index: from
the postings alone, no text is read again. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from inkwell.functions import text
from inkwell.operators import search

#: Buckets of a token or an id.
BUCKETS = search.BUCKETS
_FIELDS = search._FIELDS
_STATISTICS = "n long, tokens long, segment int"


def _bucket(col: str | Column) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(BUCKETS)).cast("int").alias("bucket")


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the segments that count, in order; one row a segment is read."""
    return sorted(r.segment for r in spark.read.schema(_STATISTICS).parquet(f"{path}/statistics").select("segment").distinct().collect())


class _Index:
    """The tables at ``path`` as its committed segments have them."""

    def __init__(self, spark: SparkSession, path: str, id_col: str, kind):
        self.segments, self.id = committed(spark, path), id_col
        fields = StructType().add(id_col, kind)
        for name in _FIELDS:
            fields = fields.add(name, "string")
        fields = fields.add("length", IntegerType())
        tail = lambda s: s.add("segment", IntegerType()).add("bucket", IntegerType())
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}").where(F.col("segment").isin(self.segments))
        self.postings = read("postings", tail(StructType(list(fields)).add("token", "string").add("tf", IntegerType())))
        self.documents = read("documents", tail(StructType().add(id_col, kind).add("length", IntegerType())))
        self.stale = read("stale", StructType().add(id_col, kind).add("length", IntegerType()).add("dead", IntegerType()).add("segment", IntegerType()))
        counts = spark.read.schema(_STATISTICS).parquet(f"{path}/statistics")
        self.statistics = counts.agg(F.sum("n").alias("n"), (F.sum("tokens") / F.nullif(F.sum("n"), F.lit(0))).alias("average"))
        self.totals = counts.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))

    def live(self, rows: DataFrame) -> DataFrame:
        """``rows`` of postings or documents without those of versions that later segments replaced or deleted."""
        return rows.join(self.stale.select(self.id, F.col("dead").alias("segment")), [self.id, "segment"], "left_anti")


def _put(rows: DataFrame, path: str, name: str, number: int, *order: str) -> None:
    """One segment's folder of a table; by bucket, in this order, where it has buckets."""
    if not order:
        return rows.write.mode("overwrite").parquet(f"{path}/{name}/segment={number}")
    rows.sortWithinPartitions("bucket", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}/segment={number}")


def _texts(docs: DataFrame, path: str, number: int, id_col: str, text_col: str) -> DataFrame:
    """Write postings and documents of a batch; the documents, read back. Texts are cut into tokens once: the documents come from the empty token's postings."""
    rows = docs.select(id_col, *_FIELDS, text.tokens(F.col(text_col)).alias("toks")).withColumn("length", F.size("toks"))
    _put(search.counted(rows, [id_col, *_FIELDS, "length"], whole=True), path, "postings", number, "token", id_col)
    kind = docs.schema[id_col].dataType
    fields = StructType().add(id_col, kind).add("length", IntegerType())
    read = lambda name, schema: docs.sparkSession.read.schema(schema.add("bucket", IntegerType())).parquet(f"{path}/{name}/segment={number}")
    whole = read("postings", StructType(list(fields)).add("token", "string")).where(search.in_buckets(docs.sparkSession, [""]))
    _put(whole.select(id_col, "length", _bucket(id_col)).hint("rebalance", "bucket"), path, "documents", number, id_col)
    own = read("documents", fields)
    if own.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).limit(1).count():
        raise ValueError(f"{id_col} must be there and differ from row to row")
    return own


def _count(path: str, number: int, own: DataFrame, gone: DataFrame) -> None:
    both = own.select(F.lit(1).alias("sign"), "length").union(gone.select(F.lit(-1), "length"))
    both.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("sign") * F.col("length")), F.lit(0)).cast("long").alias("tokens")).coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics/segment={number}")


def create(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "search_text") -> None:
    """A new index of ``docs`` as segment 0, in a folder that has none yet.

    Ids are unique and not null, else ValueError. Null texts have no tokens; they count as documents. Columns
    beside id, fields and text are not read.
    """
    own = _texts(docs, path, 0, id_col, text_col)
    gone = own.select(id_col, "length", F.lit(0).alias("dead")).limit(0)
    _put(gone, path, "stale", 0)
    _count(path, 0, own, gone)


def update(docs: DataFrame, deleted: DataFrame, path: str, number: int, id_col: str = "id", text_col: str = "search_text") -> bool:
    """Segment ``number``: adds or replaces ``docs`` and deletes the ids of ``deleted`` that aren't in ``docs``.

    Whether it was written: a segment that counts already is left as it is, so a batch may be sent
    again; one that a lost run left half written is replaced. Numbers rise. Unknown and null ids in
    ``deleted`` change nothing. Only the buckets of the batch's ids are looked up.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    index = _Index(spark, path, id_col, kind)
    if number in index.segments:
        return False
    if number <= index.segments[-1]:
        raise ValueError(f"segment {number} comes after segment {index.segments[-1]}")
    own = _texts(docs, path, number, id_col, text_col)
    touched = own.select(id_col).union(deleted.select(F.col(id_col).cast(kind))).where(F.col(id_col).isNotNull()).distinct()
    asked = [r.bucket for r in touched.select(_bucket(id_col)).distinct().collect()]  # at most BUCKETS
    before = index.live(index.documents.where(F.col("bucket").isin(asked)).join(touched, id_col, "left_semi"))
    _put(before.select(id_col, "length", F.col("segment").alias("dead")), path, "stale", number)
    gone = spark.read.schema(StructType().add(id_col, kind).add("length", IntegerType()).add("dead", IntegerType())).parquet(f"{path}/stale/segment={number}")
    _count(path, number, own, gone)
    return True


def find(spark: SparkSession, path: str, query_tokens: list[str], filters: dict | None = None, id_col: str = "id", group_col: str = "publisher", kind: str = "string") -> DataFrame:
    """One query over the index: the answer that an index of the live documents alone would give."""
    index = _Index(spark, path, id_col, kind)
    postings = index.postings.where(search.in_buckets(spark, query_tokens) & (F.col("token") != ""))
    return search.from_postings(index.live(postings), index.statistics, query_tokens, filters, id_col, group_col)


def merged(spark: SparkSession, path: str, into: str, id_col: str = "id", kind: str = "string") -> None:
    """The live rows of the index at ``path`` as segment 0 of a new index at ``into``; ``path`` stays as it is."""
    index = _Index(spark, path, id_col, kind)
    # Rows lie by bucket already: the scan packs small files into a task, and nothing is shuffled but for many stale rows.
    _put(index.live(index.postings).drop("segment"), into, "postings", 0, "token", id_col)
    _put(index.live(index.documents).drop("segment"), into, "documents", 0, id_col)
    _put(index.stale.drop("segment").limit(0), into, "stale", 0)
    index.totals.coalesce(1).write.mode("overwrite").parquet(f"{into}/statistics/segment=0")
