"""Refresh of a passage corpus: only documents that arrived since the last run are cut and written.

    python -m jobs.refresh_corpus --documents DIR --corpus DIR --checkpoint DIR

Files of the documents table are a stream; the checkpoint remembers those that were taken. Each batch
writes folders of its own, named by its number:

* ``passages/batch=N/shelf=PUBLISHER``: the passages of articles that are new or whose text has changed,
* ``articles/batch=N``: these articles, with the fingerprint of their text,
* ``log/batch=N``: what was read, left out and written.

A batch that is run again replaces its own folders and reads only those of earlier batches, so that a
run that died is made good by the next one. Nothing of an earlier batch is written again; readers
take ``current``: each article as it last was, and of articles of one text only the first by id.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import chunks

log = logging.getLogger("refresh_corpus")

ARTICLES = "id {id}, publisher string, lang string, fingerprint string, characters int, change string, passages long, batch long"
PASSAGES = "id {id}, publisher string, lang string, chunk_no int, section_path string, content string, chunk_id string, fingerprint string, batch long, shelf string"
COUNTS = ("rows_read", "without_id", "repeated", "unchanged", "new", "changed", "passages")


def _table(spark: SparkSession, corpus: str, name: str, kind: str) -> DataFrame:
    ddl = {"articles": ARTICLES, "passages": PASSAGES}[name].format(id=kind)
    return spark.read.schema(ddl).option("basePath", f"{corpus}/{name}").parquet(f"{corpus}/{name}")


def _exactly(path: str) -> str:
    """The path as a pattern that only it matches: a stream takes a table of one file or of a folder by it."""
    folder, _, name = path.rstrip("/").rpartition("/")
    return f"{folder}/{{{name}}}"


def latest(articles: DataFrame) -> DataFrame:
    """Each article as the last batch that has it says."""
    row = F.max_by(F.struct("publisher", "lang", "fingerprint", "characters", "passages", "batch"), "batch")
    return articles.groupBy("id").agg(row.alias("a")).select("id", "a.*")


def current(spark: SparkSession, corpus: str, kind: str = "long") -> DataFrame:
    """The corpus as it stands: passages of each article's last text, of equal texts those of the least id."""
    rows = latest(_table(spark, corpus, "articles", kind))
    first = rows.groupBy("fingerprint").agg(F.min("id").alias("id"))
    kept = rows.join(first, ["fingerprint", "id"]).select("id", "batch")
    return _table(spark, corpus, "passages", kind).join(kept, ["id", "batch"]).drop("shelf", "batch")


def refresh(spark: SparkSession, documents: str, corpus: str, checkpoint: str, target: int = chunks.TARGET, overlap: int = chunks.OVERLAP, files_per_batch: int = 1000) -> None:
    """Takes what is new in ``documents`` (doc_id, text, lang, source) into ``corpus``, and ends.

    Rows without an id are counted and left out. Of rows of one id in a batch the one of the
    latest file counts, then that of the greatest fingerprint; a null text is an empty one, and an empty text
    has no passages. A row whose text is the one that its article has already is left out as unchanged.
    """
    kind = spark.read.parquet(documents).schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, text string, lang string, source string"
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch).parquet(_exactly(documents))
    stream = stream.select("*", F.col("_metadata.file_modification_time").alias("arrived"))

    taken = []

    def apply(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession  # the stream's own session; streams turn adaptive execution off
        own.conf.set("spark.sql.adaptive.enabled", "true")
        taken.append(number)
        for name in ("articles", "passages"):  # a table without files can be read
            empty = own.createDataFrame([], {"articles": ARTICLES, "passages": PASSAGES}[name].format(id=kind))
            empty.write.mode("append").partitionBy("batch").parquet(f"{corpus}/{name}")
        rows = batch.select(F.col("doc_id").alias("id"), F.col("source").alias("publisher"), "lang", F.coalesce("text", F.lit("")).alias("text"), "arrived")
        rows = rows.withColumn("fingerprint", F.sha2(F.col("text").cast("binary"), 256))
        about = F.struct("publisher", "lang", "fingerprint", F.length("text").alias("characters"))
        newest = rows.where("id is not null").groupBy("id").agg(F.max_by(about, F.struct("arrived", about)).alias("a"), F.count("*").alias("n")).select("id", "a.*", "n")
        before = latest(_table(own, corpus, "articles", kind).where(F.col("batch") < number)).select("id", F.col("fingerprint").alias("old"))
        change = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("fingerprint"), "unchanged").otherwise("changed")
        judged = newest.join(before, "id", "left").withColumn("change", change).drop("old")
        fresh = judged.where("change != 'unchanged'")

        # Whole texts meet the decisions once; what comes of it is written before it is counted.
        texts = rows.select("id", "fingerprint", "text").where("id is not null").dropDuplicates(["id", "fingerprint"])  # copies of a row go on the map side
        texts = texts.join(fresh.select("id", "fingerprint", "publisher", "lang").hint("merge"), ["id", "fingerprint"])
        made = chunks.chunk(texts.drop("fingerprint"), "id", "text", target, overlap, keep=["publisher", "lang"])
        made = made.withColumn("shelf", F.coalesce(F.nullif("publisher", F.lit("")), F.lit("unknown")))
        # Shelves of any size: large ones are split and small ones joined as the shuffle's sizes say.
        made.hint("rebalance", "shelf").write.mode("overwrite").partitionBy("shelf").parquet(f"{corpus}/passages/batch={number}")
        counts = _table(own, corpus, "passages", kind).where(F.col("batch") == number).groupBy("id").agg(F.count("*").alias("passages"))
        written = fresh.drop("n").join(counts, "id", "left").withColumn("passages", F.coalesce("passages", F.lit(0)).cast("long"))
        written.write.mode("overwrite").parquet(f"{corpus}/articles/batch={number}")

        found = _table(own, corpus, "articles", kind).where(F.col("batch") == number)
        done = found.agg(F.count_if(F.col("change") == "new").alias("new"), F.count_if(F.col("change") == "changed").alias("changed"), F.coalesce(F.sum("passages"), F.lit(0)).alias("passages"))
        seen = newest.agg(F.count("*").alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("with_id"))
        read = rows.agg(F.count("*").alias("rows_read"), F.count_if(F.col("id").isNull()).alias("without_id"))
        line = read.crossJoin(seen).crossJoin(done).withColumn("repeated", F.col("with_id") - F.col("ids")).withColumn("unchanged", F.col("ids") - F.col("new") - F.col("changed"))
        line.select(*COUNTS).coalesce(1).write.mode("overwrite").json(f"{corpus}/log/batch={number}")
        said = own.read.schema(", ".join(f"{c} long" for c in COUNTS)).json(f"{corpus}/log/batch={number}").first()
        log.info("batch %d of %s into %s: %s", number, documents, corpus, ", ".join(f"{c} {said[c]}" for c in COUNTS))

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not taken:
        log.info("nothing new in %s", documents)


if __name__ == "__main__":
    from jobs.command import main

    main(refresh, "refresh_corpus", {"documents": "table of documents, growing by files", "corpus": "folder of the corpus", "checkpoint": "folder of the stream's checkpoint"})
