"""Evidence for a list of questions: the best passages of a corpus for each, and which questions lack any.

    python -m jobs.collect_evidence --documents DIR --questions DIR --path DIR

Writes three tables, each replaced as a whole, so that the job can be run again at any time:

* ``passages/shelf=PUBLISHER``: all passages that were searched,
* ``evidence/shelf=PUBLISHER``: at most twelve passages a question and three an article, with score and place,
* ``questions``: each question with its number of tokens, how much evidence it has, and whether that suffices.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import chunks, search

log = logging.getLogger("collect_evidence")

#: Settings of the session that the library's operators may change.
CHANGED = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
SUMMARY = 220


def _written(rows: DataFrame, path: str, *by: str) -> DataFrame:
    rows.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path) if by else rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def evidence(spark: SparkSession, path: str) -> DataFrame:
    """Each question and its evidence, in order of rank; questions without any have one row without a passage."""
    return spark.read.parquet(f"{path}/questions").join(spark.read.parquet(f"{path}/evidence").drop("shelf"), "question_id", "left")


def collect(spark: SparkSession, documents: str, questions: str, path: str, target: int = chunks.TARGET, overlap: int = chunks.OVERLAP, languages: Sequence[str] = (), publishers: Sequence[str] = ()) -> None:
    """Searches ``documents`` (doc_id, text, lang, source) for each of ``questions`` (item_id, text).

    Scores are BM25 with the statistics of all searched passages; ``languages`` and ``publishers`` narrow what is searched.
    A null text has no passages; a question without tokens, or whose best passages match too little, has no
    evidence; equal scores go by passage id. Question ids are taken as they are: of rows of one id and
    different texts each is a question of its own only if its id is, so ids must be unique.
    """
    held = {name: spark.conf.get(name, None) for name in CHANGED}
    try:
        docs = spark.read.parquet(documents)
        if languages:
            docs = docs.where(F.col("lang").isin(*languages))
        if publishers:
            docs = docs.where(F.col("source").isin(*publishers))
        asked = spark.read.parquet(questions).select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
        rows = chunks.chunk(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("publisher")), "id", "text", target, overlap, keep=["publisher"])
        rows = rows.withColumnRenamed("id", "article_id").withColumn("search_text", F.concat_ws(" ", "section_path", "content"))
        rows = _written(rows.withColumn("shelf", F.coalesce(F.nullif("publisher", F.lit("")), F.lit("unknown"))), f"{path}/passages", "shelf")

        best = search.search_many(rows, asked, "chunk_id", "article_id", "search_text", "question_id", "question")
        best = best.select("question_id", "chunk_id", "article_id", "score", F.col("matched").cast("int").alias("matched"), "rank")
        # At most twelve rows a question meet the passages once more.
        found = F.broadcast(best).join(rows.select("chunk_id", "article_id", "section_path", F.substring("content", 1, SUMMARY).alias("summary"), "publisher", "shelf"), ["chunk_id", "article_id"])
        found = _written(found, f"{path}/evidence", "shelf")
        count = found.groupBy("question_id").agg(F.count("*").alias("n_evidence"), F.count_distinct("article_id").alias("n_articles"))
        state = asked.select("question_id", F.size(F.array_distinct(text.tokens(F.col("question")))).alias("n_tokens")).join(count, "question_id", "left").fillna(0, ["n_evidence", "n_articles"])
        state = _written(state.withColumn("insufficient", F.col("n_evidence") == 0), f"{path}/questions")
        said = state.agg(F.count("*").alias("n"), F.count_if("insufficient").alias("without"), F.coalesce(F.sum("n_evidence"), F.lit(0)).alias("rows")).first()
        log.info("read %s (%d passages) and %s (%d questions); wrote %d rows of evidence to %s; %d questions without", documents, rows.count(), questions, said.n, said.rows, path, said.without)
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


if __name__ == "__main__":
    from jobs.command import main

    main(collect, "collect_evidence", {"documents": "table of documents", "questions": "table of questions", "path": "folder of the output"})
