"""Records of JSON ledgers of any size: one array, or an object that holds one, cut at its elements by many tasks.

A ledger is one JSON value, so where an element starts depends on all that comes before: on whether a
string is open, and how deep brackets are. Spark's text reader splits a file at every ``}``; each split
is summed up for both answers to the first question, a running sum over these few rows gives every split the state it
starts in, and then each cuts out its elements by itself. Elements that lie over a border are put together from their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.scratch import Scratch

_MARK = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_DEEPER = {"{": 1, "[": 1, "}": -1, "]": -1}


class Sum:
    """What a split does to the state: whether it has an odd number of quotes, and its depth if it starts outside and inside of a string."""

    def __init__(self) -> None:
        self.odd, self.outside, self.inside, self.first = False, 0, 0, ""

    def take(self, text: str) -> None:
        self.first = self.first or text.lstrip()[:1]
        for m in _MARK.finditer(text):
            mark = m.group()
            if mark == '"':
                self.odd = not self.odd
            elif step := _DEEPER.get(mark):
                if self.odd:
                    self.inside += step
                else:
                    self.outside += step


class Cutter:
    """Elements of a split that starts in a known state. ``level``: the depth of the array that holds them."""

    def __init__(self, quoted: bool, depth: int, level: int):
        self.quoted, self.depth, self.level = quoted, depth, level
        self.key: str | None = None  # the last name seen in the outermost object
        self.said: str | None = None  # the last string there
        self.word: int | None = None
        self.parts: list[str] | None = [] if depth > level else None  # of the open element
        self.ours = False  # whether the open element began in this split
        self.entry: tuple[str, bool] | None = None  # the end of an element that began before, and whether it ended here

    def take(self, text: str) -> Iterator[tuple[str | None, str]]:
        """(name, element) of each element that begins and ends in the split."""
        start = 0
        for m in _MARK.finditer(text):
            mark, at = m.group(), m.start()
            if mark == '"':
                self.quoted = not self.quoted
                if self.depth == 1 and self.level == 2:
                    if self.quoted:
                        self.word = at + 1
                    else:
                        self.said = text[self.word : at] if self.word is not None else None
                        self.word = None
                continue
            step = _DEEPER.get(mark)
            if self.quoted or not step:
                continue
            if step > 0:
                if self.depth == 1 and self.level == 2:
                    self.key = self.said
                if self.depth == self.level and mark == "{":
                    self.parts, self.ours, start = [], True, at
                self.depth += 1
                continue
            self.depth -= 1
            if self.depth == self.level and self.parts is not None:
                whole = "".join([*self.parts, text[start : at + 1]])
                if self.ours:
                    yield self.key, whole
                elif self.entry is None:
                    self.entry = whole, True
                self.parts, self.ours = None, False
        if self.parts is not None:
            self.parts.append(text[start:])
        self.word = None

    def edges(self) -> tuple[str | None, bool, str | None]:
        """The part of an element that began before, whether it ended here, and the part of one that goes on."""
        rest = "".join(self.parts) if self.parts is not None else None
        if rest is not None and not self.ours:
            return rest, False, None
        return (*(self.entry or (None, False)), rest)


def _runs(batches: Iterator[pa.RecordBatch], made) -> Iterator[tuple[object, tuple, str | None]]:
    """For each text its split's state; after a split's last text once more, with None."""
    held, state = None, None
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
            place = row[:-1]
            if place != held:
                if held is not None:
                    yield state, held, None
                held, state = place, made(place)
            yield state, held, row[-1] + "}"
    if held is not None:
        yield state, held, None


def elements(spark: SparkSession, path: str, name: str | None = "articles", rows: int = 2000) -> DataFrame:
    """(file, element) for each object of the array that a ledger is, or holds under ``name``, as JSON text.

    ``path`` is a file, a folder or a pattern; a ledger without the array has no rows, and elements that are no objects none.
    Other arrays and objects of a ledger are passed over, whatever they hold. Memory is bounded by the longest element and
    the longest text between two closing braces. Names that themselves hold a closing brace aren't found. Ledgers in compressed
    files have one split each.
    """
    scratch = Scratch(spark, "ledgers")
    text = spark.read.option("lineSep", "}").text(path)
    text = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for state, place, value in _runs(batches, lambda place: Sum()):
            if value is None:
                done.append((*place, state.odd, state.outside, state.inside, state.first))
            else:
                state.take(value)
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["file", "block", "odd", "outside", "inside", "first"])

    # From here on a row a split.
    sums = text.mapInArrow(summed, "file string, block long, odd boolean, outside long, inside long, first string")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("quoted", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    sums = sums.withColumn("depth", F.coalesce(F.sum(F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("outside"))).over(before), F.lit(0)))
    level = F.when(F.first(F.nullif("first", F.lit("")), ignorenulls=True).over(order) == "[", 1).otherwise(2)
    states = scratch.table(sums.select("file", "block", "quoted", "depth", level.alias("level")), "states")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for state, place, value in _runs(batches, lambda place: Cutter(*place[2:])):
            if value is None:
                done.append((*place[:2], state.key, None, True, *state.edges()))
            else:
                done += [(*place[:2], key, found, False, None, False, None) for key, found in state.take(value)]
            if len(done) >= rows:
                yield packed(done)
                done = []
        if done:
            yield packed(done)

    def packed(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.large_string(), pa.bool_(), pa.large_string(), pa.bool_(), pa.large_string()]
        columns = [pa.array(c, k).cast(pa.string()) if k == pa.large_string() else pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["file", "block", "key", "element", "edge", "entry", "ended", "rest"])

    # The states are a row a split of a file (128 MB by default), so that they are small whatever the ledgers are.
    known = text.join(F.broadcast(states), ["file", "block"]).select("file", "block", "quoted", "depth", "level", "value")
    pieces = scratch.table(known.mapInArrow(cut, "file string, block long, key string, element string, edge boolean, entry string, ended boolean, rest string"), "pieces")
    edges = pieces.where("edge").select("file", "block", "key", "entry", "ended", "rest").withColumn("last", F.last("key", ignorenulls=True).over(before))
    # An element over borders: its first part, and the parts that follow it up to the one that ends it.
    edges = edges.withColumn("mine", F.count("rest").over(before))
    heads = edges.where("rest is not null").select("file", (F.col("mine") + 1).alias("mine"), F.coalesce("key", "last").alias("name"), "rest")
    tails = edges.where("entry is not null").groupBy("file", "mine").agg(F.array_sort(F.collect_list(F.struct("block", "ended", "entry"))).alias("parts"))
    upto = F.array_position(F.transform("parts", lambda p: p.ended), True).cast("int")
    over = heads.join(tails, ["file", "mine"]).where(upto > 0).select("file", "name", F.concat("rest", F.array_join(F.transform(F.slice("parts", F.lit(1), upto), lambda p: p.entry), "")).alias("element"))
    names = edges.select("file", "block", "last")
    whole = pieces.where("not edge").join(F.broadcast(names), ["file", "block"]).select("file", F.coalesce("key", "last").alias("name"), "element")
    levels = F.broadcast(states.where("block = 0").select("file", "level"))
    found = whole.unionByName(over).join(levels, "file")
    return found.where((F.col("level") == 1) | F.col("name").eqNullSafe(F.lit(name))).select("file", "element")


def records(spark: SparkSession, path: str, schema: str, name: str | None = "articles") -> DataFrame:
    """Ledger records of a schema; see ``elements``. The schema is given, never inferred."""
    return elements(spark, path, name).select(F.from_json("element", f"struct<{schema}>").alias("r")).select("r.*")
