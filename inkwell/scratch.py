"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it
again: a lost executor then costs the tasks that it ran, never a recomputation of the
stages before. Only a local session that has no such folder gets one of its own.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from the session's ``spark.checkpoint.dir``."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="inkwell-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return f"file://{_own[app]}"


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what Python workers get at once, unless the session says so itself."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Batches in slices of ``rows``: a worker holds the Python objects of one slice, however many rows a batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


class Scratch:
    """A folder of intermediate tables that belong to one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        bounded_batches(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a frame that reads the written rows."""
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, paths: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in paths:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        gc.collect()
        jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, and free the shuffles behind them."""
        self._delete([f"{self.path}/{name}" for name in names])

    def remove(self) -> None:
        """Delete all tables of the folder."""
        self._delete([self.path])


#: Bytes of files from which it is worth dealing them out.
LEAST = 1 << 20


def spread(rows: DataFrame) -> DataFrame:
    """A freshly read table, dealt over the cores where its scan has fewer tasks than there are cores, or where few of them have the rows.

    A file of one row group is one task, however long its texts take; cut by its size it is several, of which one
    has all rows. A scan that keeps all cores busy stays as it is, and nothing is shuffled for this.
    """
    execution = rows._jdf.queryExecution()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if int(str(execution.optimizedPlan().stats().sizeInBytes())) < LEAST:
        return rows
    tasks = execution.toRdd().getNumPartitions()
    if tasks < cores:
        return rows.repartition(cores)
    # counted from the files' footers
    held = rows.groupBy(F.spark_partition_id().alias("task")).count().agg(F.count("*").alias("busy"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    if held["busy"] >= cores and held["most"] * cores <= 2 * held["all"]:
        return rows
    # by a number, not in turns: for those a task would sort its rows first, and here it has many
    return rows.repartition(tasks, F.rand(0))


def parallelism(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions of the session, at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
