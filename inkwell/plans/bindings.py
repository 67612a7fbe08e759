"""The test tables read as the corpus model's tables, for Spark and, as text, for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.scratch import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def ledger(spark: SparkSession, sf_dir: str, merge: bool = False) -> DataFrame:
    """documents and labels as articles: nullable dates, scores, priorities and decorated URLs.

    ``merge``: a merge join at every size, where whole texts go through it.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    labels = labels.hint("merge") if merge else labels
    tail = F.when(F.col("doc_id") % 4 == 0, "/").when(F.col("doc_id") % 4 == 1, F.concat(F.lit("?utm_source=x&id="), "doc_id")).when(F.col("doc_id") % 4 == 2, "#top").otherwise("")
    topics = F.create_map(*[F.lit(x) for x in ("en", "ai-operating-model", "fr", "data-architecture", "de", "consumer-brand", "es", "governance-risk-trust")])
    return docs.join(labels, "doc_id", "left").select(
        F.format_string("doc-%06d", "doc_id").alias("id"), "doc_id", F.col("source").alias("publisher"), "lang", F.col("text").alias("content"),
        F.substring(F.substring_index("text", "\n", 1), 1, 120).alias("title"),
        F.when(F.col("doc_id") % 7 != 0, F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 240).cast("int")), "yyyy-MM-dd")).alias("published_at"),
        F.try_element_at(topics, F.col("lang")).alias("category"),
        F.when(F.col("toxic") == 1, "track").when(F.col("quality") == 1, "must-read").when(F.col("quality") == 0, "reference").alias("priority"),
        F.when(F.col("quality").isNotNull(), (F.col("doc_id") * 37 % 101).cast("double")).alias("score_total"),
        F.when(F.col("doc_id") % 3 == 0, 10.0).when(F.col("doc_id") % 3 == 1, 100.0).alias("score_scale"),
        F.concat(F.lit("https://"), "source", F.lit(".Example.com/"), "lang", F.lit("/Item-"), (F.col("doc_id") - F.col("doc_id") % 2).cast("string"), tail).alias("url"),
    )


LEDGER = """ledger AS (
    SELECT 'doc-' || lpad(doc_id::VARCHAR, 6, '0') AS id, doc_id, source AS publisher, lang, text AS content,
           substr(string_split(text, chr(10))[1], 1, 120) AS title,
           CASE WHEN doc_id % 7 <> 0 THEN strftime(DATE '2026-01-01' + (doc_id % 240)::INT, '%Y-%m-%d') END AS published_at,
           CASE lang WHEN 'en' THEN 'ai-operating-model' WHEN 'fr' THEN 'data-architecture' WHEN 'de' THEN 'consumer-brand' WHEN 'es' THEN 'governance-risk-trust' END AS category,
           CASE WHEN toxic = 1 THEN 'track' WHEN quality = 1 THEN 'must-read' WHEN quality = 0 THEN 'reference' END AS priority,
           CASE WHEN quality IS NOT NULL THEN (doc_id * 37 % 101)::DOUBLE END AS score_total,
           CASE doc_id % 3 WHEN 0 THEN 10.0::DOUBLE WHEN 1 THEN 100.0::DOUBLE END AS score_scale,
           'https://' || source || '.Example.com/' || lang || '/Item-' || (doc_id - doc_id % 2) ||
           CASE doc_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '?utm_source=x&id=' || doc_id WHEN 2 THEN '#top' ELSE '' END AS url
    FROM documents LEFT JOIN labels USING (doc_id))"""


def searchable(rows: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.withColumn("search_text", text.weighted(F.col("title"), none, none, none, F.col("content")))


SEARCHABLE = """toks AS (
    SELECT *, regexp_extract_all(lower(repeat(coalesce(title, '') || ' ', 3) || coalesce(content, '')), '[a-z0-9][a-z0-9+._-]*') AS t FROM ledger)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as (source, translation) pairs: Markdown made from the text, then damaged by rule."""
    docs = table(spark, sf_dir, "documents")
    source = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\nSee https://example.com/a?id="), "doc_id", F.lit(", 12.5% of 1,000 in 2026.\n"))
    damaged = F.when(F.col("doc_id") % 5 == 0, F.replace(source, F.lit("# "), F.lit(""))).when(F.col("doc_id") % 5 == 1, F.replace(source, F.lit("12.5%"), F.lit("12,5 percent")))
    damaged = damaged.when(F.col("doc_id") % 5 == 2, F.replace(source, F.lit("https://"), F.lit("see "))).when(F.col("doc_id") % 5 == 3, F.replace(source, F.lit("\n\n"), F.lit("\n"))).otherwise(source)
    translation = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(damaged, F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("企业治理"), 400)).otherwise("")))
    return docs.select(F.col("doc_id").alias("id"), F.col("source").alias("publisher"), source.alias("source"), translation.alias("translation"))


PAIRS = r"""raw AS (SELECT doc_id AS id, source AS publisher, '# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))
           || chr(10) || chr(10) || 'See https://example.com/a?id=' || doc_id || ', 12.5% of 1,000 in 2026.' || chr(10) AS source FROM documents),
pairs AS (SELECT id, publisher, source, CASE WHEN id % 11 = 0 THEN '' ELSE
           CASE id % 5 WHEN 0 THEN replace(source, '# ', '') WHEN 1 THEN replace(source, '12.5%', '12,5 percent') WHEN 2 THEN replace(source, 'https://', 'see ')
                       WHEN 3 THEN replace(source, chr(10) || chr(10), chr(10)) ELSE source END
           || CASE WHEN id % 2 = 0 THEN repeat('企业治理', 400) ELSE '' END END AS translation FROM raw)"""


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as rows of ranked libraries: a library a brand, its first 25 parts by key."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("library"), F.col("p_partkey").alias("ordinal"), F.concat(F.lit("s-"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), "p_size", "p_retailprice")


SCENARIOS = """rows0 AS (SELECT p_brand AS library, p_partkey AS ordinal, 's-' || p_partkey AS id, p_name AS title, p_size, p_retailprice FROM part),
rows1 AS (SELECT *, row_number() OVER (PARTITION BY library ORDER BY ordinal) - 1 AS i FROM rows0),
rows2 AS (SELECT *, CASE WHEN i < 3 THEN 'P0' WHEN i < 18 THEN 'P1' WHEN i < 23 THEN 'P2' ELSE 'P3' END AS priority FROM rows1),
built AS (SELECT *, CASE priority WHEN 'P0' THEN [26, 18, 13, 13, 14] WHEN 'P1' THEN [23, 15, 11, 11, 14] WHEN 'P2' THEN [19, 12, 9, 9, 11] ELSE [22, 8, 6, 5, 7] END AS card FROM rows2)"""
