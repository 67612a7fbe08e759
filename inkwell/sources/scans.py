"""Scans: JSON metadata trees, sidecars, indexed pages, search dumps, captions, event lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.sources import ledgers


def metadata(spark: SparkSession, root: str, schema: str, name: str = "metadata.json") -> DataFrame:
    """All files of one name below a folder, with their paths; the schema is given, never inferred."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    return rows.withColumn("path", F.col("_metadata.file_path"))


def latest(rows: DataFrame, key: str = "id", order: str = "path") -> DataFrame:
    """The last row of each key in the order of paths."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("turn", turn).where("turn = 1").drop("turn")


def ledger_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON array, or of an object that holds it under ``articles``; a large file is cut by many tasks."""
    return ledgers.records(spark, path, schema)


def sidecars(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, body) of a text file that may lie beside each record; join left, missing is empty."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_path"), r"/[^/]*$", "").alias("folder"), F.col("value").alias("body"))


def indexed_lines(parts: DataFrame, id_col: str = "page", text_col: str = "raw") -> DataFrame:
    """Pages given in parts as ``L<n>: text``: the longest text of a line wins, lines go in order."""
    found = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^L(\d+):[ \t]?(.*)$"), F.lit(0))).alias("line")
    rows = parts.select(id_col, found).select(id_col, F.regexp_extract("line", r"^L(\d+):", 1).cast("long").alias("n"), F.regexp_replace("line", r"^L\d+:[ \t]?", "").alias("text"))
    best = rows.groupBy(id_col, "n").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("n", "text")))
    pages = best.groupBy(id_col).agg(ordered.alias("lines"))
    total = F.element_at("lines", -1).getField("n")
    return pages.select(id_col, F.array_join(F.transform("lines", lambda x: x.text), "\n").alias("body"), F.size("lines").alias("captured"), total.alias("total"), (F.size("lines") / F.greatest(total, F.lit(1))).alias("coverage"))


def accepted(pages: DataFrame, coverage: float = 0.98, characters: int = 300) -> DataFrame:
    return pages.where((F.col("coverage") >= coverage) & (F.length("body") >= characters))


#: Lines of an index's pages that are no text (fixed values).
SKIPPED = "(?i)^(Skip to main content|Explore a career with us)$"


def indexed_pages(parts: DataFrame, id_col: str = "page", text_col: str = "raw", ordinal: str = "part") -> DataFrame:
    """Pages given in parts as a search index shows them: body, total and captured lines, coverage, characters.

    A part says ``Total lines: n`` and marks each line ``L<n>:`` anywhere. The longest text of a
    line wins, the first of equal ones; citations go, lone heading marks take their title, and
    empty lines are no more than two in a row. A page without a total has no coverage.
    """
    total = F.coalesce(F.expr(f"try_cast(regexp_extract({text_col}, 'Total lines:\\\\s*([0-9]+)', 1) as bigint)"), F.lit(0))
    totals = parts.groupBy(id_col).agg(F.max(total).alias("total"))
    marked = F.regexp_extract_all(F.col(text_col), F.lit(r"(?s)L(\d+):\s?(.*?)(?=L\d+:|\z)"), F.lit(0))
    rows = parts.select(id_col, F.col(ordinal).alias("_part"), F.posexplode(marked).alias("_at", "_line"))
    value = F.regexp_replace(F.regexp_replace("_line", r"^L\d+:\s?", ""), r"\n\s*=== NEXT CHUNK ===[\s\S]*$", "")
    rows = rows.select(id_col, "_part", "_at", F.regexp_extract("_line", r"^L(\d+):", 1).cast("long").alias("n"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("text"))
    best = rows.groupBy(id_col, "n").agg(F.max_by("text", F.struct(F.length("text"), -F.col("_part"), -F.col("_at"))).alias("text"))
    lines = best.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("lines"))
    clean = F.filter(F.transform("lines", lambda x: text.without_citations(x.text)), lambda x: ~x.rlike(SKIPPED))
    body = F.regexp_replace(F.regexp_replace(text.joined_headings(F.array_join(clean, "\n")), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    pages = totals.join(lines, id_col, "left").select(id_col, F.coalesce(body, F.lit("")).alias("body"), "total", F.greatest(F.coalesce(F.size("lines"), F.lit(0)), F.lit(0)).cast("long").alias("captured"))
    share = F.when(F.col("total") > 0, F.col("captured") / F.col("total")).otherwise(0.0)
    return pages.withColumn("coverage", share).withColumn("characters", text.word_characters(F.col("body")))


def least_coverage(pages: DataFrame) -> DataFrame:
    """Pages and the least coverage among them."""
    return pages.agg(F.count("*").alias("pages"), F.min("coverage").alias("least"))


def listing(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """(folder, name, size) of the files below a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return rows.select(F.regexp_replace("path", r"/[^/]*$", "").alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("length").alias("size"))


def with_file(rows: DataFrame, files: DataFrame, name: str, column: str, folder: str = "folder") -> DataFrame:
    """``rows`` with the path of a file that may lie in their folder; null where it doesn't."""
    there = files.where(F.col("name") == name).select(F.col("folder").alias(folder)).distinct().withColumn("_there", F.lit(True))
    path = F.when(F.col("_there"), F.concat(F.col(folder), F.lit(f"/{name}")))
    return rows.join(there, folder, "left").withColumn(column, path).drop("_there")


def search_block(raw: Column) -> Column:
    """The first result of a search dump: title, URL and text below its header line."""
    head = r"(?m)^(.+?) \((https?://[^\s)]+)\)$"
    block = F.regexp_extract(raw, r"(?m)^.+? \(https?://[^\s)]+\)$\n?([\s\S]*?)(?=^.+? \(https?://[^\s)]+\)$|\z)", 1)
    body = F.regexp_replace(F.array_join(F.slice(F.split(block, "\n"), 3, 1_000_000), "\n"), r"\s+$", "")
    return F.struct(F.regexp_extract(raw, head, 1).alias("title"), F.regexp_extract(raw, head, 2).alias("url"), body.alias("body"))


def transcript(vtt: Column) -> Column:
    """Caption text: cue numbers, times and tags go, a repeated line stays once."""
    lines = F.transform(F.split(vtt, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        lines = _replaced(lines, entity, plain)
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^WEBVTT|^\d+$|-->|^(NOTE|STYLE|REGION)\b"))
    return F.array_join(F.array_distinct(kept), "\n\n")


def _replaced(lines: Column, entity: str, plain: str) -> Column:
    return F.transform(lines, lambda x: F.replace(x, F.lit(entity), F.lit(plain)))


EVENT = "type string, stage string, message string"


def event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One event a line; blank lines are skipped, a malformed one becomes an error event."""
    rows = lines.where(F.trim(column) != "").withColumn("event", F.from_json(column, EVENT, {"mode": "PERMISSIVE"}))
    bad = F.col("event.type").isNull()
    return rows.select(F.when(bad, "error").otherwise(F.col("event.type")).alias("type"), F.when(~bad, F.col("event.stage")).alias("stage"), F.when(bad, "malformed event").otherwise(F.col("event.message")).alias("message"))
