"""Merkle manifest of a table (operator 11): leaves by row, a subtree by group, one root.

A row's digest is a leaf. Within a group leaves stand in the order of their ids, and every
ARITY consecutive nodes become their digest until one is left; the groups' subroots become
the root likewise. Large blocks of consecutive leaves are reduced over the cluster. What
is left above them, at most TOP nodes and one a group, is built by the driver; a block gets the
siblings above it as its suffix path from a broadcast, and the executors finish the proofs
and fold each row up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, bounded_batches, parallelism

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Most block roots that the driver builds the upper tree from (about 17 MB of digests). It gives the
#: blocks' height: LEAST_HEIGHT levels up to 134 million rows, one more for each eightfold beyond.
TOP, LEAST_HEIGHT = 1 << 18, 3
#: Most groups; each has a subroot in the upper tree.
GROUPS = 1 << 17
#: Rows folded at once.
ROWS = 4096


def digest(values: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the values, one behind the other: ``-`` if null, else UTF-8 bytes, ``:``, value."""
    parts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in parts]).cast("binary"), 256)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def above(nodes: list[str]) -> list[str]:
    """The next level of a tree."""
    return [sha("".join(nodes[i : i + ARITY])) for i in range(0, len(nodes), ARITY)]


def levels(nodes: list[str], least: int = 0) -> list[list[str]]:
    """All levels up to the one of a single node; ``least`` levels are built even above a single node."""
    out = [nodes]
    while len(out[-1]) > 1 or len(out) <= least:
        out.append(above(out[-1]))
    return out


def path(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings before and after node ``i`` of the lowest level, level by level."""
    out = []
    for nodes in tree[:-1]:
        first = i - i % ARITY
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + ARITY])))
        i //= ARITY
    return out


class Upper:
    """The tree above the blocks: a tree of block roots a group, and one of the groups' subroots."""

    def __init__(self, roots: dict[int, list[str]]):
        self.trees = {group: levels(found) for group, found in sorted(roots.items())}
        self.rank = {group: i for i, group in enumerate(self.trees)}
        self.groups = levels([tree[-1][0] for tree in self.trees.values()]) if self.trees else []

    @property
    def root(self) -> str:
        return self.groups[-1][0]

    def subroot(self, group: int) -> str:
        return self.trees[group][-1][0]

    def suffix(self, group: int, block: int) -> list[tuple[str, str]]:
        return path(self.trees[group], block) + path(self.groups, self.rank[group])


def prove(leaves: list[str], found: list[str | None], height: int, suffix: list[tuple[str, str]]) -> Iterator[tuple[int, list[str], list[str]]]:
    """Of the leaves of one block, ROWS at a time: the first row, digests of the proofs, and what each found leaf folds up to."""
    tree = levels(leaves, height)
    tail = "".join(before + after for before, after in suffix)
    for first in range(0, len(leaves), ROWS):
        proofs, folded, own, upper = [], [], None, []
        for i in range(first, min(first + ROWS, len(leaves))):
            if i // ARITY != own:  # the siblings above a run are those of all of it
                own = i // ARITY
                upper = path(tree, i)[1:] + suffix
                rest = "".join(b + a for b, a in upper[: len(upper) - len(suffix)]) + tail
            start = own * ARITY
            before, after = ("".join(leaves[start:i]), "".join(leaves[i + 1 : start + ARITY])) if len(tree) > 1 else ("", "")
            proofs.append(sha(before + after + rest))
            node = found[i] or leaves[i]
            for b, a in ([(before, after)] if len(tree) > 1 else []) + upper:
                node = sha(b + node + a)
            folded.append(node)
        yield first, proofs, folded


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", changed: Column | None = None, changes: dict[str, Column] | None = None, top: int = TOP) -> DataFrame:
    """One row per row of ``docs``: the id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    ``changes`` gives values that fields are found to have now, where ``changed`` is true: such a
    row's leaf is computed again from these and folded with the siblings of the manifest, and
    is verified only if that meets the root. Columns that aren't fields don't count and aren't carried.

    A null value is a value of its own, other than the empty text. Groups ascend by the bytes of
    their names, null first, leaves by id, null first; rows of one id by their leaves, and rows
    that are equal in all fields have equal leaves, whose places are exchangeable in every tree but
    not in the proofs: each place has one row. A group of one row is its own subroot and a single
    group's subroot the root. An empty table gives no rows. More than GROUPS groups are refused.
    Leaves are ordered by a range shuffle of digests in which equal rows are dealt out too; no text is
    shuffled, and what is collected is one row a block, partition or group.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "merkle")
    kind = docs.schema[id_col].dataType.simpleString()
    col = lambda name: F.col(f"`{name}`")
    leaf = digest([col(f) for f in fields])
    found = F.when(F.coalesce(changed, F.lit(False)), digest([(changes or {}).get(f, col(f)) for f in fields])) if changed is not None else F.lit(None).cast("string")
    slim = docs.select(col(id_col).alias("id"), col(group_col).cast("string").alias("g"), F.unhex(leaf).alias("leaf"), F.unhex(found).alias("found"), F.monotonically_increasing_id().alias("at"))
    slim = scratch.table(slim, "leaves")
    order = [F.col("g").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("at")]
    # Written in order: a row's number tells its partition and its place there.
    ranged = slim.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    ordered = scratch.table(ranged.select("id", "g", "leaf", "found", F.monotonically_increasing_id().alias("at")), "ordered")
    part = F.shiftright("at", 33)

    stretches = ordered.groupBy(part.alias("p"), "g").agg(F.min("at").alias("first"), F.count("*").alias("n")).orderBy("first")
    stretches = stretches.limit(GROUPS + 2 * parallelism(spark)).collect()
    shifts, n, names = [], {}, {}
    for s in stretches:
        group = names.setdefault(s.g, len(names))
        shifts.append((s.p, s.g, group, n.get(group, 0) - s.first))
        n[group] = n.get(group, 0) + s.n
    if len(names) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups")
    height = LEAST_HEIGHT
    while sum(n.values()) > top * ARITY**height:
        height += 1
    size = ARITY**height

    # A row a partition and a group.
    of = F.broadcast(spark.createDataFrame(shifts, "p long, name string, grp int, shift long"))
    placed = ordered.join(of, (part == F.col("p")) & F.col("g").eqNullSafe(F.col("name"))).withColumn("pos", F.col("at") + F.col("shift"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "id", "leaf", "found")))
    blocks = placed.groupBy("grp", F.expr(f"pos div {size}").alias("block")).agg(rows.alias("rows"))
    several = F.broadcast(spark.createDataFrame([(g, k > size) for g, k in n.items()], "grp int, several boolean"))
    blocks = blocks.join(several, "grp").withColumn("nodes", F.expr("transform(rows, r -> lower(hex(r.leaf)))"))
    for _ in range(height):  # a tree of one block ends at its root, the blocks of others all have one height
        runs = F.expr(f"transform(sequence(0, (size(nodes) - 1) div {ARITY}), i -> sha2(cast(array_join(slice(nodes, i * {ARITY} + 1, {ARITY}), '') as binary), 256))")
        blocks = blocks.withColumn("nodes", F.when(F.col("several") | (F.size("nodes") > 1), runs).otherwise(F.col("nodes")))
    blocks = scratch.table(blocks.select("grp", "block", "several", F.element_at("nodes", 1).alias("block_root"), F.col("rows.id").alias("ids"), F.col("rows.leaf").alias("leaves"), F.col("rows.found").alias("found")), "blocks")

    roots: dict[int, list[str]] = {}
    for r in sorted(blocks.select("grp", "block", "block_root").toArrow().to_pylist(), key=lambda r: (r["grp"], r["block"])):
        roots.setdefault(r["grp"], []).append(r["block_root"])
    scratch.drop("leaves", "ordered")
    shared = spark.sparkContext.broadcast(Upper(roots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                group, block, several = (batch.column(c)[k].as_py() for c in range(3))
                ids = batch.column(3)[k].values
                leaves = [x.hex() for x in batch.column(4)[k].as_py()]
                seen = [x.hex() if x else None for x in batch.column(5)[k].as_py()]
                subroot, root = upper.subroot(group), upper.root
                for first, proofs, folded in prove(leaves, seen, height if several else 0, upper.suffix(group, block)):
                    m = len(proofs)
                    same = [pa.array([x] * m, pa.string()) for x in (subroot, root)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(first, m), pa.array(leaves[first : first + m]), *same, pa.array(proofs), pa.array(folded), pa.array([x == root for x in folded])],
                        [id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                    )
        vec.release()

    names_out = f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.select("grp", "block", "several", "ids", "leaves", "found").mapInArrow(run, names_out)


def lowered(text: Column) -> Column:
    """``text`` with A to Z in lower case and nothing else changed."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.translate(text.cast("string"), upper, upper.lower())
