"""Upkeep of the archive: written bodies, imports, enrichment, audits, queue order, names and summaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text

#: Files that every archived article has (fixed values).
FILES = {"snapshot": "原始网页.html", "source": "英文原文.md", "translation": "中文全文.md"}
COVERAGE, CHARACTERS = 0.98, 300


def directory(index: int, title: str | None) -> str:
    """NNN-slug: compatible forms in lower case, letters, numbers and marks, at most 96 characters; ``untitled`` if none is left."""
    plain = re.sub(r"[\x00-\x1f\x7f]", " ", unicodedata.normalize("NFKC", title or "").lower())
    slug = regex.sub(r"[^\p{L}\p{N}\p{M}]+", "-", plain).strip("-") or "untitled"
    return f"{index:03d}-{slug[:96].rstrip('-')}"


def directories(rows: DataFrame, index: str = "archive_index", title: str = "title", id_col: str = "id") -> DataFrame:
    """(id, directory) of each row."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [directory(i or 0, t) for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_col, "directory"])

    return rows.select(id_col, F.col(index).cast("long"), title).mapInArrow(run, f"`{id_col}` {kind}, directory string")


def written(archive: DataFrame, pages: DataFrame) -> DataFrame:
    """The archive (id, snapshot, source, translation) after pages (id, snapshot, source) were written into it.

    Snapshot and source are replaced, so that writing twice changes nothing; a translation is
    made empty where there is none and never touched where there is one. With hashes of both bodies.
    """
    new = pages.select("id", F.col("snapshot").alias("new_snapshot"), F.concat(F.regexp_replace(text.blank(F.col("source")), r"^\s+|\s+$", ""), F.lit("\n")).alias("new_source"), F.lit(True).alias("new"))
    rows = archive.select("id", "snapshot", "source", "translation").join(new, "id", "full")
    pick = lambda c: F.when(F.col("new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    rows = rows.select("id", pick("snapshot"), pick("source"), F.coalesce("translation", F.lit("")).alias("translation"))
    return rows.withColumn("snapshot_sha256", F.sha2(F.col("snapshot").cast("binary"), 256)).withColumn("source_sha256", F.sha2(F.col("source").cast("binary"), 256))


BUCKETS = 64


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))


def write_archive(archive: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """The archive as a table by hash of the id: all of it appears at once, when the job commits."""
    parts = bucketed(archive, buckets)
    parts.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return archive.sparkSession.read.schema(parts.schema).parquet(path).drop("bucket")


def update_archive(archive: DataFrame, path: str, rows: DataFrame, change: Callable[[DataFrame, DataFrame], DataFrame], buckets: int = BUCKETS) -> DataFrame:
    """The archive at ``path`` after ``change(archived rows, rows)`` in the buckets that ``rows`` (with an id) fall into.

    Only these buckets are read, and only their files are replaced; all others stay as they are. ``archive``
    gives the table's columns, as ``write_archive`` returned it; ``change`` keeps them and adds or replaces rows but takes
    none away: ``written`` with pages, or ``enriched`` with patches, for example. Rows of null ids have a bucket of their own. Updating twice
    with the same rows is updating once if ``change`` is so. Spark writes the new files aside
    and puts them in place when the job commits; a number of buckets other than the archive's is refused.
    """
    spark, columns = rows.sparkSession, archive.columns
    touched = [r.bucket for r in bucketed(rows.select("id"), buckets).select("bucket").distinct().collect()]  # at most ``buckets``
    table = spark.read.schema(bucketed(archive, buckets).schema).parquet(path)
    before = table.where(F.col("bucket").isin(touched))
    if before.where(F.col("bucket") != F.pmod(F.xxhash64("id"), F.lit(buckets))).limit(1).count() or table.where(F.col("bucket") >= buckets).limit(1).count():
        raise ValueError(f"the archive at {path} doesn't have {buckets} buckets")
    after = bucketed(change(before.drop("bucket"), rows).select(*columns), buckets)
    # One task a bucket would be as large as the bucket; the shuffle's sizes say how it is cut.
    after.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(table.schema).parquet(path).drop("bucket")


def imported(pages: DataFrame, records: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Indexed pages (id, body, coverage, characters) into the archive: archive rows, the whole state, and what was refused.

    A page is taken with coverage of 0.98 and 300 characters or more; its state then says
    downloaded, whatever it said before. Pages of unknown records are refused.
    """
    judged = pages.join(records.select("id", "url", "title"), "id", "left")
    why = F.when(F.col("url").isNull(), "unknown record").when((F.col("coverage") < COVERAGE) | (F.col("characters") < CHARACTERS), "incomplete page")
    judged = judged.withColumn("problem", why)
    taken = judged.where("problem is null")
    rows = taken.select(
        "id", "url", "title", F.col("body").alias("source"), text.heading_count(F.col("body")).alias("heading_count"), F.size(F.filter(F.split("body", r"\n{2,}"), lambda b: b != "")).alias("paragraph_count"),
        "characters", "coverage", F.sha2(F.col("body").cast("binary"), 256).alias("sha256"),
    )
    mine = taken.select("id", "url", F.lit("downloaded").alias("status"), F.sha2(F.col("body").cast("binary"), 256).alias("sha256"), F.lit("extracted").alias("extraction"), F.lit("web_index_fallback").alias("retrieval"))
    rest = state.join(taken.select("id"), "id", "left_anti").select("id", "url", "status", "sha256", "extraction", F.lit(None).cast("string").alias("retrieval"))
    return rows, rest.unionByName(mine), judged.where("problem is not null").select("id", "problem", "coverage", "characters")


def enriched(archive: DataFrame, patches: DataFrame) -> DataFrame:
    """The archive (id, source, extraction, ...) with the text of patches (id, markdown, extraction, method, linked_url) in place of its own, counted and hashed anew."""
    new = patches.select("id", F.concat(F.regexp_replace(text.blank(F.col("markdown")), r"^\s+|\s+$", ""), F.lit("\n")).alias("_text"), F.col("extraction").alias("_extraction"), "method", "linked_url")
    rows = archive.join(new, "id", "left")
    rows = rows.withColumn("source", F.coalesce("_text", "source")).withColumn("extraction", F.coalesce("_extraction", "extraction")).withColumn("changed", F.col("_text").isNotNull()).drop("_text", "_extraction")
    paragraphs = F.size(F.filter(F.split("source", r"\n{2,}"), lambda b: b != ""))
    return rows.withColumn("character_count", text.word_characters(F.col("source"))).withColumn("heading_count", F.regexp_count("source", F.lit(r"(?m)^#{1,6}\s+"))).withColumn("paragraph_count", paragraphs).withColumn("sha256", F.sha2(F.col("source").cast("binary"), 256))


def _later(rows: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """``name``: whether a row has a value that a row of lesser ``order`` has too. Null values repeat none.

    The least order of a value is found by an aggregate, so that one in very many rows stays one row a task.
    """
    first = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(order).alias("_first"))
    return rows.join(first, value, "left").withColumn(name, F.coalesce(F.col(order) > F.col("_first"), F.lit(False))).drop("_first")


def audit_errors(articles: DataFrame, expected: int | None = None) -> DataFrame:
    """All errors of an archive (path, id, url, status, snapshot, source, translation, verified, reader_ok): label and error.

    Ids and URLs are repeated from their second article on, in the order of paths. Null ``verified``
    and ``reader_ok`` were not checked; files are what they hold, null or empty where missing.
    """
    label = F.coalesce(F.col("id"), F.regexp_replace("path", r"/[^/]*$", ""))
    rows = _later(_later(articles.withColumn("label", label), "id", "path", "_id"), "url", "path", "_url")
    full = F.col("source").isNotNull() & (F.col("source") != "") & F.col("translation").isNotNull() & (F.col("translation") != "")
    rules = [
        (text.blank(F.col("id")).eqNullSafe("") | F.col("_id"), "missing or repeated id"), (text.blank(F.col("url")).eqNullSafe("") | F.col("_url"), "missing or repeated URL"),
        (~F.coalesce(F.col("status") == "downloaded", F.lit(False)), "not downloaded"), *[(text.blank(F.col(c)) == "", f"missing or empty {name}") for c, name in FILES.items()],
        (full & ~F.coalesce(F.col("verified"), F.lit(True)), "translation not valid"), (~F.coalesce(F.col("reader_ok"), F.lit(True)), "reader not valid"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(error)) for rule, error in rules]))
    out = rows.select("label", F.explode(found).alias("error"))
    if expected is None:
        return out
    count = articles.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    return out.unionByName(count.select(F.lit("*").alias("label"), F.format_string(f"expected {expected} articles, found %d", "n").alias("error")))


def pending(entries: DataFrame, language: str = "en", limit: int | None = None, collation: str = "UNICODE") -> DataFrame:
    """Entries of a language that aren't complete, by title of their digest as a reader sorts it, then by index; at most ``limit``."""
    rows = entries.where((F.col("source_language") == language) & (F.col("status") != "complete")).orderBy(F.collate("radar_title", collation), "archive_index", "id")
    return rows if limit is None else rows.limit(limit)


def sorted_values(rows: DataFrame, columns: list[str], collation: str = "zh") -> DataFrame:
    """The distinct values of each column that aren't empty, each with its place in a reader's order."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    values = rows.select(pairs).select("p.*").where("coalesce(value, '') != ''").distinct()
    return values.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.collate("value", collation), "value")))


def summaries(articles: DataFrame, markdown: str = "markdown") -> DataFrame:
    """(id, summary): the ledger's core view, else the archive's, else the text's first paragraph of substance."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return articles.select("id", F.coalesce(some("ledger_core"), some("archive_core"), text.lead_paragraph(F.col(markdown))).alias("summary"))


def write_state(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """State rows as a table and their summary as lines of JSON beside them; each appears whole."""
    rows.write.mode("overwrite").parquet(f"{folder}/rows")
    summary.coalesce(1).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/summary")


def write_readers(readers: DataFrame, path: str, violations) -> DataFrame:
    """Rendered readers (id, html) as a table, checked again as they were written: the violations found."""
    readers.write.mode("overwrite").parquet(path)
    return violations(readers.sparkSession.read.schema(readers.schema).parquet(path))


def dataset_errors(coverage: DataFrame, candidates: DataFrame, records: DataFrame, maxima: dict[str, int]) -> DataFrame:
    """All errors of a refresh's dataset: place and error.

    coverage is one row (discovered, included, excluded, failed); candidates (i, status, reason);
    records (i, id, source_url, canonical_url, published_at, window_status, category, secondary, facts,
    dimensions, reasons, total, priority, confidence_level, confidence_reason, fingerprint, status) with
    facts as (text, locator), dimensions and reasons as maps by name.
    """
    counts = candidates.agg(F.count("*").alias("n"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("included", "excluded", "failed")])
    kept = records.agg(F.count("*").alias("n_records"))
    whole = coverage.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(kept))
    differ = lambda a, b: ~F.coalesce(F.col(a) == b, F.lit(False))
    rules = [(differ("discovered", F.col("included") + F.col("excluded") + F.col("failed")), "discovered is not the sum"), (differ("discovered", F.col("n")), "discovered is not the number of candidates"), (differ("included", F.col("n_records")), "included is not the number of records")]
    rules += [(differ(s, F.col(f"n_{s}")), f"{s} does not match the candidates") for s in ("included", "excluded", "failed")]
    listed = lambda rows, place, rules: rows.select(place.alias("place"), F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(e)) for r, e in rules]))).alias("error"))
    out = listed(whole, F.lit("coverage"), rules)
    known = F.coalesce(F.col("status").isin("included", "excluded", "failed"), F.lit(False))
    out = out.unionByName(listed(candidates, F.format_string("candidate[%d]", "i"), [(~known, "unknown status"), (text.blank(F.col("reason")) == "", "no reason")]))
    empty = lambda c: text.blank(F.col(c)) == ""
    rows = _later(_later(_later(records, "id", "i", "_id"), "canonical_url", "i", "_url"), "fingerprint", "i", "_print")
    https = lambda c: ~F.coalesce(F.col(c).rlike("^https://[^/?#]+"), F.lit(False))
    point = lambda d: F.try_element_at("dimensions", F.lit(d))
    fits = lambda d, m: F.coalesce(point(d).between(0, m), F.lit(False))
    total = sum((F.when(fits(d, m), point(d)).otherwise(0) for d, m in maxima.items()), F.lit(0))
    rules = [
        (empty("id") | F.col("_id"), "id missing or repeated"), (https("source_url"), "source_url must be https"), (https("canonical_url"), "canonical_url must be https"), (F.col("_url") & F.col("canonical_url").isNotNull(), "canonical_url repeated"),
        (empty("published_at") & ~F.coalesce(F.col("window_status").isin("date_unknown", "undated"), F.lit(False)), "no date and no window status"), (empty("category") | F.col("secondary").isNull(), "category"),
        (F.exists(F.coalesce("facts", F.array().cast(records.schema["facts"].dataType)), lambda f: text.blank(f.text) == ""), "fact without text"), (F.exists(F.coalesce("facts", F.array().cast(records.schema["facts"].dataType)), lambda f: text.blank(f.locator) == ""), "fact without locator"),
        *[(~fits(d, m), f"{d} out of range") for d, m in maxima.items()], *[(text.blank(F.try_element_at("reasons", F.lit(d))) == "", f"{d} without reason") for d in maxima],
        (~F.coalesce(F.col("total") == total, F.lit(False)), "total is not the sum"), (~F.coalesce(F.col("priority").isin("must-read", "track", "reference"), F.lit(False)), "unknown priority"),
        (~F.coalesce(F.col("confidence_level").isin("high", "middle", "low"), F.lit(False)) | empty("confidence_reason"), "confidence"), (empty("fingerprint"), "no fingerprint"), (~empty("fingerprint") & F.col("_print"), "fingerprint repeated"), (~F.coalesce(F.col("status") == "included", F.lit(False)), "status must be included"),
    ]
    return out.unionByName(listed(rows, F.format_string("record[%d]", "i"), rules))

