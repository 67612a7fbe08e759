"""Incremental runs over the test tables, to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans import bindings as b
from inkwell.plans.ledger_queries import _key
from inkwell.scratch import Scratch
from inkwell.streaming import runs


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "status")
    counts = runs.status_stream(_stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    runs.keep_complete(counts, f"{scratch.path}/counts", f"{scratch.path}/checkpoint").awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{scratch.path}/counts").withColumn("day", F.col("day").cast("date"))


def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "merge")
    rows = b.ledger(spark, sf_dir).select("id", "url")
    rows.where("cast(right(id, 6) as int) % 3 = 0").write.parquet(f"{scratch.path}/ledger/batch=start")
    docs = _stream(spark, sf_dir, "documents")
    tail = F.when(F.col("doc_id") % 4 == 0, "/").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("?utm_source=x&id="), "doc_id")).when(F.col("doc_id") % 4 == 2, "#top").otherwise("")
    url = F.concat(F.lit("https://"), "source", F.lit(".Example.com/"), "lang", F.lit("/Item-"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), tail)
    additions = docs.select(F.format_string("doc-%06d", "doc_id").alias("id"), url.alias("url"))
    runs.merge_stream(additions, f"{scratch.path}/ledger", f"{scratch.path}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{scratch.path}/ledger")


QUERIES = {"stream_status_counts": status_counts, "stream_ledger_merge": ledger_merge}

ORACLES = {
    "stream_status_counts": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_ledger_merge": f"""WITH {b.LEDGER}, k AS (SELECT id, url, doc_id, {_key('url')} AS key FROM ledger), e AS (SELECT * FROM k WHERE doc_id % 3 = 0),
        a AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)
        SELECT id, url FROM e UNION ALL SELECT id, url FROM a WHERE id NOT IN (SELECT id FROM e) AND key NOT IN (SELECT key FROM e)""",
}
