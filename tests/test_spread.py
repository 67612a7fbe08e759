"""A table is dealt over the cores by the tasks that have its rows, not by those that its files' sizes make."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkwell import scratch


@pytest.fixture
def small_tasks(spark):
    """A scan's tasks of 128 kB, so that a small file is cut into many."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _written(path, rows, group, length=1000):
    texts = [f"{i:0{length}d}" for i in range(rows)]
    table = pa.table({"doc_id": pa.array(range(rows), pa.int64()), "text": texts})
    pq.write_table(table, path, row_group_size=group, compression="none", use_dictionary=False)


def _held(rows):
    return sorted(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


@pytest.mark.parametrize("group", [4000, 1000, 3900])
def test_few_large_row_groups_are_dealt_over_all_cores(small_tasks, tmp_path, group):
    spark = small_tasks
    _written(f"{tmp_path}/documents.parquet", 4000, group)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert read.rdd.getNumPartitions() >= cores > len(_held(read))
    rows = scratch.spread(read)
    held = _held(rows)
    assert len(held) >= cores and held[-1] * cores <= 2 * sum(held)
    assert sorted(r.doc_id for r in rows.select("doc_id").collect()) == list(range(4000))
    assert sorted(rows.columns) == ["doc_id", "text"]


def test_one_row_group_far_larger_than_the_others_is_dealt(small_tasks, tmp_path):
    """All cores have rows, but one has most of them: short texts in a group of their own."""
    spark = small_tasks
    (tmp_path / "documents.parquet").mkdir()
    _written(f"{tmp_path}/documents.parquet/a.parquet", 4000, 100)
    _written(f"{tmp_path}/documents.parquet/b.parquet", 60000, 60000, 1)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert len(_held(read)) >= cores and _held(read)[-1] * cores > 2 * 64000
    held = _held(scratch.spread(read))
    assert held[-1] * cores <= 2 * sum(held) == 2 * 64000


def test_a_scan_that_keeps_all_cores_busy_stays(small_tasks, tmp_path):
    spark = small_tasks
    _written(f"{tmp_path}/documents.parquet", 4000, 100)
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert scratch.spread(read) is read
