"""Windows of units (bytes or words) that occur twice anywhere in a corpus, exactly.

Shared by the suffix-array and the suffix-tree operators, which differ in their units and in
how a memory-sized group of suffixes is searched:

1. Anchors. Of the hashes of all K units in a window of T units the leftmost least one is an
   anchor (winnowing), so two equal windows have an equal anchor at one offset. A scan emits
   each anchor's key, a hash of its context (all windows that hold it) and its place.
2. Keys that occur once are dropped: only suffixes that share a prefix of K units are left.
   Equal contexts are counted, not paired: where one occurs twice, all of it is repeated.
3. The rest, one representative of each context, is fetched and dealt by key, a prefix of K
   units, into groups of bounded size, and the operator's search finds what each group repeats.
4. A key with very many different contexts (a common passage) is not put in one group: its
   contexts are sorted over the cluster by both sides of the anchor, as suffixes are, and
   neighbours say what is shared; what that leaves open has its prefix lengthened to the
   whole window, at which length equal prefixes are repeats and counting them is enough.

Nothing depends on the size of a group of copies but the rows that hold its places. Joins
whose sides grow with the table are merge joins at every size, so that small runs show what
large ones do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, parallelism

#: Units of a long text that are anchored at once; bytes of contexts in a group of suffixes;
#: contexts from which a key's prefix is lengthened.
PIECE, GROUP, MANY = 1 << 19, 2 << 20, 1500
#: Longer strings that stand for the windows of a context of such a key.
STEPS = 8
_INDEX = vec.U(21)

#: search(units, ends, first): starts and lengths of what is repeated in ``units``, whose segments
#: have these ``ends``; with ``first``, only of what also occurs earlier.
Search = Callable[[np.ndarray, np.ndarray, bool], tuple[np.ndarray, np.ndarray]]


def byte_units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return raw, at


def word_units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = vec.words(raw, at)
    return vec.word_hashes(raw, starts, ends), first


def anchors(units: np.ndarray, at: np.ndarray, t: int, k: int, thin: bool = False) -> tuple[np.ndarray, ...]:
    """Owner, place, key, context hash, context start and end (in the text) of all anchors of a block."""
    if len(at) == 2 and at[1] > 2 * PIECE:
        n, parts = int(at[1]), []
        for a in range(0, n, PIECE):
            lo, hi = max(0, a - t), min(n, a + PIECE + 2 * t)
            owner, place, key, context, start, end = _anchors(units[lo:hi], np.array([0, hi - lo]), t, k, a - lo, a - lo + PIECE, thin)
            parts.append((owner, place + lo, key, context, start + lo, end + lo))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        once = np.unique(joined[1], return_index=True)[1]
        return tuple(x[once] for x in joined)
    return _anchors(units, at, t, k, 0, len(units), thin)


def _anchors(units: np.ndarray, at: np.ndarray, t: int, k: int, low: int, high: int, thin: bool) -> tuple[np.ndarray, ...]:
    n, w = len(units), t - k + 1
    if n < t:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, vec.U, vec.U, np.int64, np.int64))
    size = np.diff(at)
    end_of = np.repeat(at[1:], size)
    gram = vec.GRAMS.windows(vec.GRAMS.prefix(units), k)
    packed = (gram >> _INDEX << _INDEX) | np.arange(len(gram), dtype=vec.U)
    pad = -len(packed) % w
    table = np.concatenate([packed, np.full(pad, ~vec.U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(packed) - w + 1], ahead[w - 1 : len(packed)])
    start = np.arange(len(least))
    least = least[(start + t <= end_of[: len(least)]) & (start >= low) & (start < high)]
    change = np.flatnonzero(np.r_[True, least[1:] != least[:-1]]) if len(least) else np.zeros(0, int)
    place = np.unique(least[change] & ((vec.U(1) << _INDEX) - vec.U(1))).astype(np.int64)
    owner = np.searchsorted(at, place, "right") - 1
    # In a periodic run every period has an anchor of one key: keep the first of each half
    # window and the last. Each window of the run still holds one of them.
    key = gram[place]
    chained = (np.diff(place) <= w // 2) & (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    if thin and chained.any():
        head = np.r_[True, ~chained]
        part = (place - np.repeat(place[head], np.diff(np.r_[np.flatnonzero(head), len(place)]))) // max(w // 2, 1)
        kept = head | np.r_[~chained, True] | np.r_[True, part[1:] != part[:-1]]
        place, owner = place[kept], owner[kept]
    lo, hi = np.maximum(at[owner], place - (t - k)), np.minimum(at[owner + 1], place + t)
    context = vec.mix(vec.CONTEXT.of(vec.CONTEXT.prefix(units), lo, hi) + (place - lo).astype(vec.U))
    base = at[owner]
    return owner, place - base, gram[place], context, lo - base, hi - base


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows differ from the one before; the first does. Null is a value."""
    null = np.asarray(column.is_null())
    same = np.asarray(pc.fill_null(pc.equal(column[1:], column[:-1]), False)) | (null[1:] & null[:-1])
    return np.r_[True, ~same] if len(column) else np.zeros(0, bool)


class Corpus:
    """The places of repeated windows of one table."""

    def __init__(self, docs: DataFrame, t: int, units: Callable, search: Search, keep_first: bool, id_col: str, text_col: str, label: str):
        self.t, self.k, self.units, self.search, self.keep_first = t, t // 3 + 1, units, search, keep_first
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, label)
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))

    def _anchored(self) -> DataFrame:
        t, k, units, thin = self.t, self.k, self.units, not self.keep_first

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, _, raw, at in vec.blocks(batch.column(1)):
                    owner, place, key, context, lo, hi = anchors(*units(raw, at), t, k, thin)
                    rows = pa.array(owner + i)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(rows), batch.column(2).take(rows),
                        pa.array(place.astype(np.int32)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)),
                    ], ["key", "context", "id", "h", "place", "lo", "hi"])

        return self.docs.mapInArrow(run, f"key long, context long, id {self.kind}, h long, place int, lo int, hi int")

    def ranges(self) -> DataFrame:
        """(id, h, ranges) of the texts with repeated windows; ranges overlap and are unsorted."""
        s, t = self.scratch, self.t
        places = s.table(self._anchored(), "places")
        # Written, so that the join has plain shuffles on both sides and a hot key's side can be split.
        twice = s.table(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")
        shared = s.table(places.join(twice.hint("merge"), "key"), "shared")
        s.drop("places", "twice")
        place = F.struct("id", "h", "place", "lo", "hi")
        contexts = s.table(shared.groupBy("key", "context").agg(F.count("*").alias("n"), F.min(place).alias("rep")), "contexts")

        # Contexts that occur twice are repeated as a whole.
        whole = shared.join(contexts.where("n > 1").select("key", "context", "rep").hint("merge"), ["key", "context"]).where(F.col("hi") - F.col("lo") >= t)
        if self.keep_first:
            whole = whole.where(~F.struct("id", "h", "place", "lo", "hi").eqNullSafe(F.col("rep")))
        found = whole.select("id", "h", F.col("lo").alias("start"), F.col("hi").alias("end"))

        # Keys with different contexts: fetch one text of each.
        keys = s.table(contexts.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "keys")
        wanted = contexts.join(keys.hint("merge"), "key").groupBy("rep.id", "rep.h").agg(F.collect_list(F.struct("key", "context", "n", "rep.place", "rep.lo", "rep.hi", (F.col("m") > MANY).alias("many"))).alias("wanted"))
        pieces = s.table(self._fetch(wanted), "pieces")
        few = pieces.where("not many").repartition(parallelism(self.spark), "key").sortWithinPartitions("key")
        found = found.unionByName(few.mapInArrow(self._searcher(), f"id {self.kind}, h long, start int, end int"))
        many = pieces.where("many")
        found = found.unionByName(self._lengthened(many) if self.keep_first else self._common(many))
        # Rows that repeat an id and a text find the same ranges: a set of them is reduced on the map side.
        out = s.table(found.groupBy("id", "h").agg(F.collect_set(F.struct("start", "end")).alias("ranges")), "ranges")
        s.drop("shared", "contexts", "keys", "pieces", "strings", "windows", "sides", "marked", "whole")
        return out

    def _fetch(self, wanted: DataFrame) -> DataFrame:
        """The units of each wanted context: bytes, or 64-bit words."""
        units = self.units
        asked = wanted.select(F.col("id").alias("want_id"), F.col("h").alias("want_h"), "wanted")
        # Rows of one id and text are one place: any of them will do. They leave the merge join one after the other.
        joined = self.docs.join(asked.hint("merge"), F.col("id").eqNullSafe(F.col("want_id")) & (F.col("h") == F.col("want_h"))).select("id", "text", "h", "wanted")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                new = _changes(batch.column(0)) | _changes(batch.column(2))
                new[0] = last is None or last != (batch.column(0)[0], batch.column(2)[0])
                last = batch.column(0)[-1], batch.column(2)[-1]
                if not new.all():
                    batch = pa.Table.from_batches([batch]).filter(pa.array(new)).combine_chunks().to_batches()
                    if not batch:
                        continue
                    batch = batch[0]
                at_want = batch.column(3).offsets.to_numpy()
                flat = batch.column(3).values
                column = {flat.type.field(i).name: flat.field(i) for i in range(flat.type.num_fields)}
                lo, hi = column["lo"].to_numpy(), column["hi"].to_numpy()
                for i, j, raw, at in vec.blocks(batch.column(1)):
                    unit, first = units(raw, at)
                    a, b = at_want[i], at_want[j]
                    if a == b:
                        continue
                    base = np.repeat(first[:-1], np.diff(at_want[i : j + 1]))
                    rows = pa.array(np.repeat(np.arange(i, j), np.diff(at_want[i : j + 1])))
                    parts = [unit[x:y].tobytes() for x, y in zip((base + lo[a:b]).tolist(), (base + hi[a:b]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(column[c].slice(a, b - a) for c in ("key", "context", "n", "place", "lo", "many")), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(parts, pa.binary())],
                        ["key", "context", "n", "place", "lo", "many", "id", "h", "units"],
                    )

        return joined.mapInArrow(run, f"key long, context long, n long, place int, lo int, many boolean, id {self.kind}, h long, units binary")

    def _kind(self) -> type:
        return np.uint8 if self.units is byte_units else np.uint64

    def _searcher(self):
        search, keep_first, kind = self.search, self.keep_first, self._kind()

        def group(rows: pa.Table) -> pa.RecordBatch | None:
            ids = rows.column("id").combine_chunks()
            h, lo, n = (rows.column(c).to_numpy() for c in ("h", "lo", "n"))
            unit, at = vec.buffers(rows.column("units").combine_chunks())
            unit, at = unit.view(kind) if kind is np.uint8 else np.frombuffer(unit.tobytes(), kind), at // np.dtype(kind).itemsize
            # Contexts of one text may overlap: lay them out so that every place is there once.
            number = ids.dictionary_encode()
            code = np.where(np.asarray(ids.is_null()), -1, number.indices.fill_null(0).to_numpy())
            rank = np.argsort(np.asarray(number.dictionary.to_numpy(zero_copy_only=False)), kind="stable").argsort(kind="stable") if len(number.dictionary) else np.zeros(0, int)
            code = np.where(code >= 0, rank[np.maximum(code, 0)] if len(rank) else -1, -1)
            size = np.diff(at)
            order = np.lexsort((lo, h, code))
            total, reach, owner = 0, 0, None
            offset, pieces, segment_end = np.zeros(len(order), np.int64), [], np.zeros(len(order), np.int64)
            ends: list[int] = []
            for r in order.tolist():
                mine = (code[r], h[r])
                start, end = int(lo[r]), int(lo[r] + size[r])
                if owner != mine or start > reach:
                    ends.append(total)
                    shift, owner, reach = total - start, mine, start
                if end > reach:
                    pieces.append(unit[at[r] + reach - start : at[r + 1]])
                    total += end - reach
                    reach = end
                offset[r] = start + shift
            ends.append(total)
            text = np.concatenate(pieces)
            limits = np.array(ends[1:], np.int64)
            start, length = search(text, limits, keep_first)
            inside = vec.covered(len(text), start, start + length)
            out = []
            for r in np.flatnonzero((n == 1) | keep_first).tolist():
                for a, b in zip(*vec.runs(inside[offset[r] : offset[r] + size[r]]), strict=True):
                    out.append((r, int(lo[r] + a), int(lo[r] + b)))
            if not out:
                return None
            row, a, b = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(h[list(row)]), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["id", "h", "start", "end"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size, last = [], 0, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = batch.column(0).to_numpy()
                cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, batch.num_rows]
                weight = np.r_[0, np.cumsum(np.diff(vec.buffers(batch.column(batch.schema.get_field_index("units")))[1]))]
                a = 0
                for x in range(len(cuts) - 1):
                    # A group ends where a key does.
                    if size + weight[cuts[x]] - weight[a] >= GROUP and key[cuts[x]] != last:
                        if cuts[x] > a:
                            held.append(batch.slice(a, cuts[x] - a))
                        if (done := group(pa.Table.from_batches(held))) is not None:
                            yield done
                        held, size, a = [], 0, int(cuts[x])
                    last = key[cuts[x]]
                held.append(batch.slice(a))
                size += weight[-1] - weight[a]
            if held and (done := group(pa.Table.from_batches(held))) is not None:
                yield done

        return run

    def _common(self, pieces: DataFrame) -> DataFrame:
        """Repeated ranges of the contexts of keys with very many of them.

        The contexts are sorted by what follows the anchor, and by what precedes it read
        backwards; neighbours in these orders share the most on that side. The range that a
        context shares on both sides is repeated as a whole where another context has it too,
        which one count of ranges tells. Only keys with a context that shares its sides with
        different ones are left to the counting of windows.
        """
        s, t, kind = self.scratch, self.t, self._kind()
        width = np.dtype(kind).itemsize

        def sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                before = (get("place").to_numpy() - get("lo").to_numpy()).tolist()
                units = [np.frombuffer(x, kind) for x in get("units").to_pylist()]
                after = [u[b:].byteswap().tobytes() for u, b in zip(units, before, strict=True)]
                ahead = [u[:b][::-1].byteswap().tobytes() for u, b in zip(units, before, strict=True)]
                yield pa.RecordBatch.from_arrays([get("key"), get("context"), pa.array(after, pa.binary()), pa.array(ahead, pa.binary())], ["key", "context", "after", "ahead"])

        sides = s.table(pieces.select("key", "context", "place", "lo", "units").mapInArrow(sided, "key long, context long, after binary, ahead binary"), "sides")
        lengths = pieces
        for name in ("after", "ahead"):
            found = s.table(self._neighbours(sides.select("key", "context", F.col(name).alias("side")), width), f"{name}_lengths")
            lengths = lengths.join(found.withColumnRenamed("length", name).hint("merge"), ["key", "context"])
        lengths = lengths.where(F.col("after") + F.col("ahead") >= t)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                place, lo, after, ahead = (get(c).to_numpy() for c in ("place", "lo", "after", "ahead"))
                marks = []
                for r, raw in enumerate(get("units").to_pylist()):
                    unit, at = np.frombuffer(raw, kind), place[r] - lo[r]
                    marks.append(int(vec.CONTEXT.windows(vec.CONTEXT.prefix(unit[at - ahead[r] : at + after[r]]), int(ahead[r] + after[r]))[0]))
                yield pa.RecordBatch.from_arrays([*(get(c) for c in ("key", "context", "n", "id", "h", "place", "after", "ahead")), pa.array(np.array(marks, np.uint64).view(np.int64))], ["key", "context", "n", "id", "h", "place", "after", "ahead", "mark"])

        marked = s.table(lengths.mapInArrow(cut, f"key long, context long, n long, id {self.kind}, h long, place int, after int, ahead int, mark long"), "marked")
        same = ["key", "ahead", "after", "mark"]
        twice = marked.groupBy(*same).agg(F.count("*").alias("m")).where("m > 1").drop("m")
        whole = s.table(marked.join(twice.hint("merge"), same, "left_semi"), "whole")
        left = marked.join(whole.select("key", "context").hint("merge"), ["key", "context"], "left_anti").select("key").distinct()
        rest = pieces.join(left.hint("merge"), "key", "left_semi")
        ranges = whole.where("n = 1").select("id", "h", (F.col("place") - F.col("ahead")).cast("int").alias("start"), (F.col("place") + F.col("after")).cast("int").alias("end"))
        return ranges.unionByName(self._lengthened(rest))

    def _neighbours(self, sides: DataFrame, width: int) -> DataFrame:
        """For each (key, context): units that ``side`` shares with its neighbours in sorted order."""
        ordered = sides.repartitionByRange(parallelism(self.spark), "key", "side", "context").sortWithinPartitions("key", "side", "context")

        def shared(a: bytes, b: bytes) -> int:
            n = min(len(a), len(b))
            x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
            return (int(x.argmax()) if x.any() else n) // width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, last, n = TaskContext.get().partitionId(), None, 0
            for batch in batches:
                rows = list(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True))
                out = []
                for row in rows:
                    length = shared(last[2], row[2]) if last and last[0] == row[0] else 0
                    if last and length:
                        out.append((last[0], last[1], length, None, None))
                    out.append((row[0], row[1], length, 2 * part if n == 0 else None, row[2] if n == 0 else None))
                    last, n = row, n + 1
                if out:
                    yield made(out)
            if last:
                yield made([(last[0], last[1], 0, 2 * part + 1, last[2])])

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["key", "context", "length", "end", "side"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # The first and the last row of each partition, in order: neighbours meet here.
            rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["end"])
            out = []
            for a, b in zip(rows[:-1], rows[1:], strict=True):
                if a["key"] == b["key"] and a["end"] // 2 != b["end"] // 2:
                    length = shared(a["side"], b["side"])
                    out += [(x["key"], x["context"], length, None, None) for x in (a, b)]
            if out:
                yield made(out)

        schema = "key long, context long, length int, end long, side binary"
        found = self.scratch.table(ordered.mapInArrow(run, schema), f"neighbours_{self._turn()}")
        met = found.where("end is not null").coalesce(1).mapInArrow(meet, schema)
        return found.unionByName(met).groupBy("key", "context").agg(F.max("length").alias("length"))

    def _turn(self) -> int:
        self.turns = getattr(self, "turns", 0) + 1
        return self.turns

    def _lengthened(self, pieces: DataFrame) -> DataFrame:
        """Repeated windows of keys with very many contexts, by longer prefixes.

        Every window with the anchor holds one of a few longer strings, at steps of a part of
        what the anchor lacks. Contexts that share none of these with another are dropped; the
        windows of the others are counted at each offset.
        """
        t, kind = self.t, self._kind()
        step = max(1, -(-(t - self.k) // STEPS))
        long = t - step + 1
        schema = f"key long, offset int, window long, n long, id {self.kind}, h long, start int"

        def hashed(width: int, every: int, within: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    get = lambda c, batch=batch: batch.column(batch.schema.get_field_index(c))
                    lo, place = get("lo").to_numpy(), get("place").to_numpy()
                    froms = get("froms").to_pylist() if within else None
                    rows, offsets, windows = [], [], []
                    for r, raw in enumerate(get("units").to_pylist()):
                        unit = np.frombuffer(raw, kind)
                        window = vec.CONTEXT.windows(vec.CONTEXT.prefix(unit), width)
                        before = int(place[r] - lo[r])
                        if within:
                            # Windows from up to a step before a surviving string to where it starts.
                            at = np.unique(np.concatenate([np.arange(before - x - step + 1, before - x + 1) for x in froms[r]]))
                        else:
                            at = before - np.arange(0, t - self_k + step, every)
                        at = at[(at >= 0) & (at < len(window))]
                        rows.append(np.full(len(at), r))
                        offsets.append(before - at)
                        windows.append(window[at])
                    if not rows:
                        continue
                    row, offset = np.concatenate(rows), np.concatenate(offsets).astype(np.int32)
                    same = pa.array(row)
                    start = pa.array((place[row] - offset).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        get("key").take(same), pa.array(offset), pa.array(np.concatenate(windows).view(np.int64)), get("n").take(same), get("id").take(same), get("h").take(same), start,
                    ], ["key", "offset", "window", "n", "id", "h", "start"])

            return run

        self_k = self.k
        same = ["key", "offset", "window"]
        row = ["key", "id", "h", "place"]
        spread = pieces.repartition(parallelism(self.spark), "key", "context")
        strings = spread.mapInArrow(hashed(long, step, False), schema).withColumn("place", (F.col("start") + F.col("offset")).cast("int"))
        strings = self.scratch.table(strings, "strings")
        twice = strings.groupBy(*same).agg(F.count("*").alias("m")).where("m > 1").select(*same)
        alive = strings.join(twice.hint("merge"), same).groupBy(*row).agg(F.collect_set("offset").alias("froms"))
        alive = alive.select(*[F.col(c).alias(f"a_{c}") for c in row], "froms")
        match = F.col("id").eqNullSafe(F.col("a_id")) & (F.col("h") == F.col("a_h")) & (F.col("place") == F.col("a_place")) & (F.col("key") == F.col("a_key"))
        windows = pieces.join(alive.hint("merge"), match).mapInArrow(hashed(t, 1, True), schema)
        windows = self.scratch.table(windows, "windows")
        counts = windows.groupBy(*same).agg(F.sum("n").alias("total"), *([F.min(F.struct("id", "h", "start")).alias("first")] if self.keep_first else [])).where("total > 1")
        hit = windows.join(counts.hint("merge"), same)
        hit = hit.where(~F.struct("id", "h", "start").eqNullSafe(F.col("first"))) if self.keep_first else hit.where("n = 1")
        return hit.select("id", "h", "start", (F.col("start") + t).cast("int").alias("end"))

    def rewritten(self, finish: Callable, schema: str, names: list[str], kept: pa.DataType) -> DataFrame:
        """Every row of the table with its repeated ranges: id and what ``finish(text, starts, ends)`` yields."""
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), kept]
        ranges = self.ranges().select(F.col("id").alias("range_id"), F.col("h").alias("range_h"), "ranges")
        full = self.docs.join(ranges.hint("merge"), F.col("id").eqNullSafe(F.col("range_id")) & (F.col("h") == F.col("range_h")), "left").select("id", "text", "ranges")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                at, flat = lists.offsets.to_numpy(), lists.values
                start, end = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                rows, rows_size = [], 0
                a = 0
                for i, text in enumerate(batch.column(1)):
                    raw = text.as_py().encode()
                    rows.append(finish(raw, start[at[i] : at[i + 1]], end[at[i] : at[i + 1]]))
                    rows_size += len(raw)
                    if rows_size >= 8 << 20:
                        yield result(batch.column(0).slice(a, len(rows)), rows)
                        a, rows, rows_size = i + 1, [], 0
                if rows:
                    yield result(batch.column(0).slice(a, len(rows)), rows)

        def result(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", *names])

        return full.mapInArrow(run, f"id {self.kind}, {schema}")


def sha256(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)
