"""Archive runs, audits, manifests and the translation queue."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import ordering, translation
from inkwell.scratch import Scratch

BLOCKED = (401, 403, 451)
RETRIED = (429, 500, 502, 503, 504)


def archive_index(articles: DataFrame, group: str, ordinal: str) -> DataFrame:
    return articles.withColumn("archive_index", F.row_number().over(Window.partitionBy(group).orderBy(ordinal)))


def outcome(http: Column, failed: Column) -> Column:
    return F.when(http.isin(*BLOCKED), "blocked").when(failed | (http >= 400), "failed").otherwise("downloaded")


def retried(http: Column, attempts: int = 4, base_ms: int = 500) -> Column:
    """Waits before each further attempt, or none for a status that isn't retried."""
    waits = F.array(*[F.lit(base_ms * 2 ** (n - 1)) for n in range(1, attempts)])
    return F.when(http.isin(*RETRIED) | http.isNull(), waits).otherwise(F.array().cast("array<int>"))


def pending(records: DataFrame, state: DataFrame) -> DataFrame:
    """Records without a finished download of the same URL."""
    done = state.where((F.col("status") == "downloaded") & F.col("sha256").isNotNull()).select("id", F.col("url").alias("done_url"))
    return records.join(done, (records["id"] == done["id"]) & (records["url"] == done["done_url"]), "left_anti")


def retry(records: DataFrame, state: DataFrame, status: str) -> DataFrame:
    return records.join(state.where(F.col("status") == status).select("id"), "id", "left_semi")


def summary(state: DataFrame) -> DataFrame:
    """Counts by status and by extraction status in one table."""
    sets = state.select(F.explode(F.array(F.col("status"), F.concat(F.lit("extraction:"), F.coalesce("extraction", F.lit("unknown"))))).alias("label"))
    return sets.groupBy("label").agg(F.count("*").alias("n"))


def audit(articles: DataFrame) -> DataFrame:
    """Totals by publisher (null: unknown), and one row for all."""
    named = articles.withColumn("publisher", F.coalesce("publisher", F.lit("unknown")))
    counts = [
        F.count("*").alias("articles"), F.count_distinct("id").alias("unique_ids"), F.count_distinct("url").alias("unique_urls"),
        F.count_if(F.col("verified")).alias("verified"), F.count_if(~F.coalesce(F.col("verified"), F.lit(False))).alias("unverified"),
    ]
    total = named.agg(*counts).withColumn("publisher", F.lit("*"))
    return named.groupBy("publisher").agg(*counts).unionByName(total)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids on one side only; empty where the sets are equal."""
    a, b = left.select("id").distinct().withColumn("l", F.lit(1)), right.select("id").distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("r").isNull(), "left").otherwise("right")
    return a.join(b, "id", "full").where("l is null or r is null").select("id", side.alias("only_in"))


def csv_cell(col: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(col.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def manifest(articles: DataFrame, columns: list[str], order: str) -> DataFrame:
    """One quoted line a record, in order."""
    return articles.select(F.col(order), F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]).alias("line"))


def write_manifest(articles: DataFrame, path: str, columns: list[str], order: str) -> None:
    rows = articles.select(order, *columns).orderBy(order).select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def create_if_missing(existing: DataFrame, proposed: DataFrame, key: str = "id") -> DataFrame:
    """Existing rows win; only missing keys are added."""
    return existing.unionByName(proposed.join(existing.select(key), key, "left_anti"))


def upsert(base: DataFrame, patches: DataFrame, key: str = "id", order: str = "updated_at") -> DataFrame:
    """The latest row of each key."""
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc("source_rank"))
    both = base.withColumn("source_rank", F.lit(0)).unionByName(patches.withColumn("source_rank", F.lit(1)))
    return both.withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn", "source_rank")


def _status(pending: Column, verified: Column) -> Column:
    return F.when(pending, "pending").when(verified, "complete").otherwise("invalid").alias("status")


def _source() -> list[Column]:
    return [text.source_language(F.col("source")).alias("source_language"), F.length(F.coalesce("source", F.lit(""))).alias("source_characters")]


def queue(pairs: DataFrame) -> DataFrame:
    """Queue state of (id, source, translation, verified): pending without a translation, else complete or invalid."""
    return pairs.select("id", "publisher", "archive_index", *_source(), _status(F.coalesce("translation", F.lit("")) == "", F.col("verified")))


def queue_checked(pairs: DataFrame) -> DataFrame:
    """Queue state of (id, publisher, archive_index, source, translation) with the verdict of the translation's own check, and what it found wrong."""
    done = F.coalesce(F.trim("translation") != "", F.lit(False))
    # What the queue says of a row goes through the check with it; an untranslated one has no text there.
    rows = pairs.select("id", "publisher", "archive_index", *_source(), (~done).alias("pending"), F.when(done, F.col("source")).alias("source"), F.when(done, F.col("translation")).alias("translation"))
    said = ["publisher", "archive_index", "source_language", "source_characters"]
    checked = translation.verify(rows, keep=[*said, "pending"]).select("id", *said, _status(F.col("pending"), F.col("ok")), F.array_join("errors", ",").alias("errors"))
    return checked.withColumn("errors", F.when(F.col("status") == "invalid", F.col("errors")))


def workers(n: int, most: int = 12) -> int:
    """A number of concurrent workers: a whole one from 1 to ``most``."""
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= most:
        raise ValueError(f"workers must be a whole number from 1 to {most}")
    return n


def in_reader_order(entries: DataFrame, group: str = "publisher", name: str = "directory", collation: str = "zh", tie: str = "id") -> DataFrame:
    """Entries with their place in their group, by directory as a reader sorts it."""
    return entries.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.collate(name, collation), name, tie)))


def queue_counts(entries: DataFrame) -> DataFrame:
    """pending counts all that isn't complete, invalid ones among them."""
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("status") != "complete").alias("pending"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.col("status") == "invalid").alias("invalid"))


def queue_filter(entries: DataFrame, publisher: str | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    out = entries
    if publisher is not None:
        out = out.where(F.col("publisher") == publisher)
    if low is not None:
        out = out.where(F.col("archive_index") >= low)
    return out.where(F.col("archive_index") <= high) if high is not None else out


#: Entries of a publisher that are cut into batches by one task at once.
BLOCK = 20_000


def jumps(sizes: Sequence[int | None], n: int, items: int, characters: int) -> list[int]:
    """For each of the first ``n`` places: where the next batch would start if a batch started there.

    ``sizes`` go on behind the ``n`` places by ``items`` more, or to the publisher's end.
    """
    size = [x or 0 for x in sizes]
    out, used, end = [], 0, 0
    for i in range(n):
        if end <= i:
            used, end = size[i], i + 1
        while end < len(size) and end - i < items and used + size[end] <= characters:
            used += size[end]
            end += 1
        out.append(end)
        used -= size[i]
    return out


def passage(nexts: Sequence[int], items: int) -> list[tuple[int, int]]:
    """What a block does to a batch start: for each of the places where its first batch may start, where the first batch behind the block starts (counted from its end) and how many start in it."""
    n = len(nexts)
    exits = [0] * n
    counts = [0] * n
    for i in range(n - 1, -1, -1):
        j = nexts[i]
        exits[i], counts[i] = (exits[j], counts[j] + 1) if j < n else (j - n, 1)
    return [(exits[s], counts[s]) if s < n else (s - n, 0) for s in range(items)]


def batches(entries: DataFrame, items: int = 10, characters: int = 100_000, block: int | None = None) -> DataFrame:
    """Greedy batches of one publisher's entries in order of index: at most ``items`` and ``characters``.

    An entry that is too long is a batch by itself. Null sizes count as none; rows of equal places go by
    their size, null publishers are one. A publisher may hold most entries: its order is cut into blocks, and the block that
    follows it by ``items`` entries tells for each place where the next batch would start. Where a batch starts in a
    block depends on the ones before it only by one of ``items`` places, so a block is summed up by what it does to
    each of these; one scan over these sums gives every block its first start, and the blocks are cut side by side.
    """
    if items < 1:
        raise ValueError("a batch holds one entry or more")
    block = max(block or BLOCK, items)
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}
    scratch = Scratch(entries.sparkSession, "batches")
    placed = ordering.numbered(entries.select("publisher", "id", "archive_index", "source_characters"), "publisher", ["archive_index", "id", "source_characters"], scratch)
    # The first entries of a block are the last that the block before it sees.
    own = F.floor(F.col("place") / block).cast("long")
    seen = F.when((F.col("place") >= block) & (F.col("place") % block < items), F.array(own, own - 1)).otherwise(F.array(own))
    rows = placed.select("publisher", "id", "place", "source_characters", F.explode(seen).alias("block"))
    entry = F.struct("place", "id", F.col("source_characters").cast("long").alias("size"))
    rows = rows.groupBy("publisher", "block").agg(F.array_sort(F.collect_list(entry)).alias("rows"))
    rows = scratch.table(rows.select("publisher", "block", F.col("rows.id").alias("ids"), F.col("rows.size").alias("sizes")), "blocks")

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [passage(jumps(sizes, min(len(sizes), block), items, characters), items) for sizes in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([[x[k] for x in f] for f in found], pa.list_(pa.int64())) for k in (0, 1))], ["publisher", "block", "exits", "counts"])

    def scanned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, start, number = object(), 0, 0
        for part in parts:
            starts, numbers = [], []
            for g, exits, counts in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if g != group:
                    group, start, number = g, 0, 0
                starts.append(start)
                numbers.append(number)
                start, number = exits[start], number + counts[start]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(starts, pa.int64()), pa.array(numbers, pa.int64())], ["publisher", "block", "start", "number"])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for r in range(part.num_rows):
                sizes, start, number = (part.column(k)[r].as_py() for k in (2, 3, 4))
                n = min(len(sizes), block)
                nexts, numbers = jumps(sizes, n, items, characters), []
                for i in range(n):
                    if i == start:
                        number, start = number + 1, nexts[i]
                    numbers.append(number)
                ids = part.column(1)[r].values.slice(0, n)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([r] * n, pa.int32())), ids, pa.array(numbers, pa.int64())], ["publisher", "id", "batch"])

    kind = f"publisher {kinds['publisher']}"
    sums = rows.select("publisher", "block", "sizes").mapInArrow(summed, f"{kind}, block long, exits array<long>, counts array<long>")
    # A row a block, of ``items`` numbers: the sums of even the largest publisher fit one task.
    firsts = sums.repartition("publisher").sortWithinPartitions("publisher", "block").mapInArrow(scanned, f"{kind}, block long, start long, number long")
    firsts = firsts.select(F.col("publisher").alias("_publisher"), F.col("block").alias("_block"), "start", "number")
    both = rows.join(firsts, F.col("publisher").eqNullSafe(F.col("_publisher")) & (F.col("block") == F.col("_block")))
    return both.select("publisher", "ids", "sizes", "start", "number").mapInArrow(cut, f"{kind}, id {kinds['id']}, batch long")


def directory_name(index: Column, title: Column) -> Column:
    """NNN-slug of letters, numbers and marks, at most 96 characters."""
    slug = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}\p{M}]+", "-"), "^-+|-+$", "")
    return F.concat(F.format_string("%03d-", index), F.regexp_replace(F.substring(slug, 1, 96), "-+$", ""))


def safe_path(path: Column) -> Column:
    """Four parts below the archive, a known file, nothing encoded or hidden."""
    known = path.rlike(r"^/?archive/[^/]+/[^/]+/(source|translation)\.md$|^/?archive/[^/]+/[^/]+/(index|reader)\.html$")
    return known & ~path.rlike(r"(?i)%2e|%2f|%5c|\\|/\.")


def by_publisher_rank(entries: DataFrame, publishers: list[str], other: int = 99) -> DataFrame:
    """Entries with their place in the order of publishers (unknown ones share the last) and then index."""
    place = F.array_position(F.array(*map(F.lit, publishers)), F.col("publisher"))
    rank = F.when(place > 0, place - 1).otherwise(other)
    order = Window.partitionBy("rank").orderBy("archive_index", "id")
    return entries.withColumn("rank", rank.cast("int")).withColumn("turn", F.row_number().over(order))


def inspected(candidates: DataFrame, inspections: DataFrame) -> DataFrame:
    """Candidates with the inspection of their URL as one struct, null where there was none."""
    rows = inspections.select("url", F.struct("http", "title", "characters").alias("inspection"))
    return candidates.join(rows, "url", "left")
