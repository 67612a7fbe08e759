"""N-gram Jaccard self-join by MinHash banding (operator 5).

1. One pass makes each text's set of word 5-grams and its band keys; texts with one set
   become one node with a number of copies.
2. Bands shuffle nodes on their keys; a key's nodes are tied to its least node, never paired.
3. The nodes that hang together are verified on their full sets: a bunch of bounded size in one
   task; a larger one is cut into cells, and the cells that share a band meet in tiles. The pairs
   of a tile are compared by one sparse-to-dense product. A tile gives back each node's number
   of links and a spanning forest, so that a group of near copies costs rows in proportion
   to its texts, while every link between different texts is counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import graph, vec
from inkwell.scratch import Scratch, parallelism

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.99999
WORD = r"[^\x20\x09-\x0D]"
#: Most hash functions, and most texts and words of one side of a tile.
HASHES, TILE_TEXTS, TILE_WORDS = 160, 1024, 400_000
#: Grams and texts of one side that are compared at once.
_COLUMNS, _ROWS = 512, 128


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = HASHES) -> tuple[int, int]:
    """The most rows a band, and then the fewest bands, that find a pair at the threshold with the target recall.

    A threshold so low that even bands of one row would be more than ``most`` is refused.
    """
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"a threshold of {threshold} takes more than {most} hash functions for a recall of {recall}")
    return best


def shingles(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of each distinct k-gram, by owner; a shorter text has one gram of all its words."""
    starts, ends, first = vec.words(raw, at)
    word = vec.word_hashes(raw, starts, ends)
    prefix = vec.GRAMS.prefix(word)
    count = np.diff(first)
    owner = np.repeat(np.arange(len(count)), count)
    gram = vec.GRAMS.windows(prefix, k)
    whole = owner[k - 1 :] == owner[: len(gram)] if len(gram) else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < k))
    owner = np.r_[owner[: len(gram)][whole], short]
    gram = np.r_[gram[whole], vec.GRAMS.of(prefix, first[short], first[short + 1])]
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.r_[True, (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])][: len(owner)]
    return owner[new], gram[new]


def signatures(texts: pa.Array, k: int, bands: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Set size, two halves of the set's hash, and band keys of each text, by block."""
    factor, flip = vec.mix(np.arange(1, bands * rows + 1, dtype=vec.U) << vec.U(32)) | vec.U(1), vec.mix(np.arange(1, bands * rows + 1, dtype=vec.U) << vec.U(33))
    for _, _, raw, at in vec.blocks(texts):
        owner, gram = shingles(raw, at, k)
        size = np.bincount(owner, minlength=len(at) - 1)
        full = np.flatnonzero(size)
        begin = np.r_[0, np.cumsum(size[full])[:-1]]
        halves, keys = np.zeros((2, len(size)), vec.U), np.zeros((len(size), bands), vec.U)
        if len(full):
            for h, salt in enumerate((vec.U(0x51ED), vec.U(0xC0FFEE))):
                halves[h, full] = np.add.reduceat(vec.mix(gram ^ salt), begin)
            work = np.empty_like(gram)
            for b in range(bands):
                key = np.full(len(full), vec.U(b + 1))
                for j in range(b * rows, (b + 1) * rows):
                    np.bitwise_xor(gram, flip[j], out=work)
                    np.multiply(work, factor[j], out=work)
                    key = vec.mix(key ^ np.minimum.reduceat(work, begin)) * factor[b]
                keys[full, b] = key
        yield size, halves[0], halves[1], keys


def join(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per row of ``docs``: id, class_id, copy_id, n_links, h, class_row, stays.

    A class is what hangs together by links: Jaccard of the sets of k-grams of words at or
    over the threshold. class_id is its least id (null last, then by content hash ``h``) and
    ``stays`` marks the row with that id and hash; copy_id is the least id among equal sets;
    n_links counts the other rows linked to this one, copies included; class_row tells classes
    apart. A null, empty or blank text has no set: it links to nothing and is a class of its
    own. Texts of fewer than k words have one gram of all their words. Ids may be null or
    repeated; other columns are not carried; an empty table gives no rows. The rows are read
    from tables in ``scratch``, which the caller may remove once they have been used.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram")
    bands, rows = bands_and_rows(threshold, recall)
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(signatures(batch.column(1), k, bands, rows))
            if not parts:
                continue
            size, one, two, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat], ["id", "h", "size", "k1", "k2", "keys"])
        vec.release()

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    found = slim.mapInArrow(sign, f"id {kind}, h long, size long, k1 long, k2 long, keys array<long>")
    found = scratch.table(found.withColumn("row", F.monotonically_increasing_id()), "signatures")

    # Texts of equal sets: one node, reached again through one of its rows.
    groups = found.where("size > 0").groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "row")).alias("rep"))
    groups = groups.select("k1", "k2", "copies", F.col("rep.row").alias("row"))
    nodes = groups.hint("merge").join(found.select("row", "id", "h", "size", "keys"), "row").withColumnRenamed("row", "node")
    nodes = scratch.table(nodes, "nodes")
    banded = nodes.select("node", F.explode("keys").alias("key"))
    hubs = scratch.table(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n"), "hubs")
    tied = scratch.table(banded.join(hubs.hint("merge"), "key").select("node", "key", "hub"), "tied")
    bunches = graph.contracted(tied.select("node", "hub"), scratch, "bunch")

    members = scratch.table(bunches.join(nodes.select("node", "copies", "id", "h", "size").hint("merge"), "node"), "members")
    parts = lambda: F.ceil(F.greatest(F.count("*") / TILE_TEXTS, F.sum("size") / TILE_WORDS)).cast("long")
    shape = scratch.table(members.groupBy("root").agg(parts().alias("cells")).where("cells > 1"), "shape")
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    whole = members.join(shape.hint("merge"), "root", "left_anti").select("root", "node", F.lit(0).cast("long").alias("cell"), one.alias("tiles"))
    if not shape.isEmpty():
        whole = whole.unionByName(_tiles(members, tied, shape, parts, scratch))
    placed = whole.hint("merge").join(members.select("node", "copies", "id", F.col("h").alias("hash")), "node")
    texts = slim.select(F.col("id").alias("doc"), "h", "text")
    # A merge join at every size: what small runs shuffle is in proportion to what large ones do.
    placed = placed.hint("merge").join(texts, F.col("id").eqNullSafe(F.col("doc")) & (F.col("hash") == F.col("h")))
    tiles = placed.select("root", "node", "copies", "cell", "text", F.explode("tiles").alias("t")).select("root", "t.i", "t.j", "cell", "node", "copies", "text")
    tiles = tiles.repartition(parallelism(spark), "root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    limit = Fraction(threshold).limit_denominator(10_000)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ("root", "i", "j")):
            out = _links(group, k, limit)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "links"])
        vec.release()

    links = scratch.table(tiles.mapInArrow(verify, "a long, b long, links long"), "links")
    scratch.drop("hubs", "tied", "members", "cells", "meet", "sides")
    classes = graph.components(links.where("a != b").select("a", "b"), scratch, "class")
    counts = links.groupBy("a").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "k1", "k2", "copies", "id", "h").join(classes, "node", "left").join(counts.withColumnRenamed("a", "node"), "node", "left")
    known = scratch.table(known.withColumn("root", F.coalesce("root", "node")), "known")
    first = known.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first"))
    facts = known.join(first, "root").select("k1", "k2", F.col("root").alias("class_row"), F.col("id").alias("copy_id"), F.col("first.id").alias("class_id"), F.col("first.h").alias("class_h"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    full = found.where("size > 0").select("id", "h", "row", "k1", "k2").join(facts.hint("merge"), ["k1", "k2"])
    stays = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("h") == F.col("class_h"))
    full = full.select("id", "class_id", "copy_id", "n_links", "h", "class_row", stays.alias("stays"))
    alone = found.where("size = 0").select("id", F.col("id").alias("class_id"), F.col("id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), "h", F.col("row").alias("class_row"), F.lit(True).alias("stays"))
    return full.unionByName(alone).withColumnRenamed("id", id_col)


def _tiles(members: DataFrame, tied: DataFrame, shape: DataFrame, parts, scratch: Scratch) -> DataFrame:
    """(root, node, cell, tiles) of the nodes of bunches that are too large for one task.

    They are cut by the least hub, so that most texts that share a band are in one cell; what
    one hub leads is cut again where it is too large. Only cells that share a band meet.
    """
    large = members.join(shape.hint("merge"), "root")
    led = scratch.table(large.groupBy("near").agg(parts().alias("split")).where("split > 1"), "led")
    cell = F.when(F.col("split") > 1, F.xxhash64("near", F.pmod(F.xxhash64("node"), "split"))).otherwise(F.pmod(F.xxhash64("near"), "cells"))
    large = scratch.table(large.join(led.hint("merge"), "near", "left").select("root", "node", cell.alias("cell")), "cells")
    # The cells of a key are few, and most keys have the same ones.
    meet = tied.select("node", "key").join(large.hint("merge"), "node").groupBy("root", "key").agg(F.array_sort(F.collect_set("cell")).alias("cells"))
    meet = meet.select("root", "cells").distinct().select("root", "cells", F.explode("cells").alias("i"))
    meet = meet.select("root", "i", F.explode(F.filter("cells", lambda c: c >= F.col("i"))).alias("j")).distinct()
    meet = scratch.table(meet, "meet")
    sides = meet.select("root", F.col("i").alias("cell"), "i", "j").union(meet.where("i != j").select("root", F.col("j").alias("cell"), "i", "j"))
    # Written, so that both sides of the join are plain shuffles and a hot cell can be split.
    sides = scratch.table(sides.groupBy("root", "cell").agg(F.collect_list(F.struct("i", "j")).alias("tiles")), "sides")
    return large.join(sides.hint("merge"), ["root", "cell"]).select("root", "node", "cell", "tiles")


def one_of_each(docs: DataFrame, k: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each class: the one of the least id.

    Rows that repeat both id and text are one document. Texts without a word all stay.
    """
    scratch, work = Scratch(docs.sparkSession, "representatives"), Scratch(docs.sparkSession, "ngram")
    chosen = join(docs, k, threshold, recall, id_col, text_col, work).where("stays").select(F.col(f"`{id_col}`").alias("id"), "h")
    chosen = scratch.table(chosen.groupBy("id", "h").agg(F.count("*").alias("n")), "chosen")
    work.remove()
    # The caller's row is one struct, so that no column of it can clash.
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("mine"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    kept = packed.join(chosen.hint("merge"), F.col("mine").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("h")))
    if not chosen.where("n > 1").isEmpty():
        again = (F.col("n") > 1) & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
        kept = kept.where(~again).unionByName(kept.where(again).dropDuplicates(["id", "h"]))
    return kept.select("row.*")


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in keys])
        cuts = np.r_[0, np.flatnonzero((np.diff(values) != 0).any(0)) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(values[:, a])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _links(group: pa.Table, k: int, limit: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning edges (a, b) and link counts of one tile; a node with a == b carries only its count."""
    node, first = np.unique(group.column("node").to_numpy(), return_index=True)
    group = group.take(pa.array(first))
    cell, copies = group.column("cell").to_numpy(), group.column("copies").to_numpy()
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    texts = group.column("text").combine_chunks()
    owner, gram = [], []
    for row, _, raw, at in vec.blocks(texts):
        o, g = shingles(raw, at, k)
        owner.append(o + row)
        gram.append(g)
    owner, gram = np.concatenate(owner), np.concatenate(gram)
    size = np.bincount(owner, minlength=len(node))
    cross = i != j
    rows, cols = (np.flatnonzero(cell == x) for x in (i, j))
    _, column, count = np.unique(gram, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner = owner[shared]
    column = np.unique(column[shared], return_inverse=True)[1]
    # Counts are exact in single floats: a text has fewer than 2**24 grams.
    common = np.zeros((len(rows), len(cols)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, [c, c + _COLUMNS])
        dense = np.zeros((len(node), _COLUMNS), np.float32)
        dense[owner[a:b], column[a:b] - c] = 1
        common += dense[rows] @ dense[cols].T
    linked = np.zeros(common.shape, bool)
    for i in range(0, len(rows), _ROWS):
        part = common[i : i + _ROWS].astype(np.int64)
        union = size[rows[i : i + _ROWS]][:, None] + size[cols][None, :] - part
        linked[i : i + _ROWS] = (part * limit.denominator >= limit.numerator * union) & (union > 0)
    if not cross:
        np.fill_diagonal(linked, False)
    links = np.zeros(len(node), np.int64)
    links[rows] += linked @ copies[cols]
    if cross:
        links[cols] += linked.T @ copies[rows]
    # The least node that each hangs together with: labels fall along links until none does.
    least = np.arange(len(node), dtype=np.int32)
    while True:
        before = least.copy()
        for mine, other, by in ((rows, cols, linked), (cols, rows, linked.T)):
            if len(mine) and len(other):
                least[mine] = np.minimum(least[mine], np.where(by, least[other][None, :], len(node)).min(1))
        least = least[least]
        if (least == before).all():
            break
    some = np.flatnonzero(links)
    return node[some], node[least[some]], links[some]
