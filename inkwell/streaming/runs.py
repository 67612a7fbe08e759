"""Incremental runs: event lines as a stream, resumable ledger merges, change feeds."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import urls
from inkwell.sources import scans


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events from lines of JSON that arrive as files."""
    return scans.event_lines(spark.readStream.schema("value string").format("text").load(folder))


def write_events(events: DataFrame, folder: str, checkpoint: str):
    """Each event as a line of JSON; exactly once by the sink's log."""
    lines = events.select(F.to_json(F.struct("type", "stage", "message")).alias("value"))
    return lines.writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


COMPACTED = 64


def merge_stream(additions: DataFrame, ledger_path: str, checkpoint: str, buckets: int = 256, every: int = COMPACTED):
    """Append records whose id and URL the ledger lacks, batch by batch.

    Ids and URL keys in use are kept beside the ledger in a table by hash bucket, and a batch
    reads only the buckets of its own identities. A batch writes its own folders, named by its
    number, so that a repeated batch replaces itself instead of appending twice. Of records
    that share an identity the first by id, then URL, then content stays; null ids and URLs
    are shared by none.

    Before each batch whose number ``every`` divides, the identities of all batches before it are
    written as one table, ``upto=<number>``; later batches read it and the few folders since. What the
    last such table was made from goes when the next one is there, so a repeated batch finds
    all that it read before, and there are never more than ``2 * every + 1`` folders and two tables.
    """
    spark, schema = additions.sparkSession, additions.schema
    index = f"{ledger_path.rstrip('/')}-identities"

    def identities(rows: DataFrame) -> DataFrame:
        each = F.inline(F.array(F.struct(F.lit("id").alias("kind"), F.col("id").cast("string").alias("value")), F.struct(F.lit("url").alias("kind"), urls.merge_key(F.col("url")).alias("value"))))
        return rows.select(each).where("value is not null").distinct().withColumn("bucket", F.pmod(F.xxhash64("kind", "value"), F.lit(buckets)).cast("int"))

    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    fields = "kind string, value string, bucket int"

    def written(name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/{name}")

    def folders() -> dict[tuple[str, int], str]:
        """Kind (batch, upto) and number of each whole table of identities."""
        place = hadoop(index)
        files = place.getFileSystem(conf)
        names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        pairs = [(n, n.split("=")) for n in names if n.startswith(("batch=", "upto="))]
        return {(kind, int(number)): f"{index}/{n}" for n, (kind, number) in pairs if files.exists(hadoop(f"{index}/{n}/_SUCCESS"))}

    def before(number: int) -> tuple[int, list[str]]:
        """Number of the last compaction before batch ``number`` (-2: none), and the tables that hold all identities up to the batch."""
        have = folders()
        last = max((n for kind, n in have if kind == "upto" and n <= number), default=-2)
        return last, [path for (kind, n), path in sorted(have.items()) if (kind == "upto" and n == last) or (kind == "batch" and last <= n < number)]

    def read(paths: list[str]) -> DataFrame:
        """These tables, each by its own folder of buckets."""
        tables = [spark.read.schema(fields).parquet(p) for p in paths]
        return functools.reduce(DataFrame.union, tables)

    def compact(number: int) -> None:
        last, paths = before(number)
        if last == number:
            return
        written(f"upto={number}", read(paths).distinct().hint("rebalance", "bucket"))
        for (kind, n), path in folders().items():
            if n < last:
                hadoop(path).getFileSystem(conf).delete(hadoop(path), True)

    def apply(batch: DataFrame, number: int) -> None:
        own = f"{ledger_path}/batch={number}"
        if not folders():
            ledger = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(ledger_path)
            written("batch=-1", identities(ledger.where(~F.col("_metadata.file_path").rlike(r"/batch=\d+/"))))
        if number and number % every == 0:
            compact(number)
        mine = identities(batch)
        asked = [r.bucket for r in mine.select("bucket").distinct().collect()]
        known = read(before(number)[1]).where(F.col("bucket").isin(asked))
        fresh = batch.withColumn("_key", urls.merge_key(F.col("url"))).withColumn("_row", F.xxhash64(*batch.columns))
        for name, kind in (("id", "id"), ("_key", "url")):
            taken = known.where(F.col("kind") == kind).select(F.col("value").alias("_taken"))
            fresh = fresh.join(taken, F.col(name).cast("string") == F.col("_taken"), "left_anti")
        for name in ("id", "_key"):
            # Null keys are shared by none: their rows don't meet in one task.
            turn = F.row_number().over(Window.partitionBy(name, F.when(F.col(name).isNull(), F.col("_row"))).orderBy("id", "url", "_row"))
            fresh = fresh.withColumn("_turn", turn).where(F.col(name).isNull() | (F.col("_turn") == 1))
        fresh.select(*schema.names).write.mode("overwrite").parquet(own)
        written(f"batch={number}", identities(spark.read.schema(schema).parquet(own)))

    return additions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status_stream(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Counts by event type and window, final once the watermark has passed."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "event_type", "n")


def keep_complete(counts: DataFrame, path: str, checkpoint: str):
    """The whole small result after each batch, in one folder that is replaced.

    The small result is dealt to one task; the counting before it keeps a task for each part of the state.
    """
    return counts.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.repartition(1).write.mode("overwrite").parquet(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
