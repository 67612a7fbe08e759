"""Benchmark decontamination by greedy string tiling (operator 2).

The benchmark is the query set: it is taken in blocks of bounded size, and each block's
running Karp-Rabin hashes of K tokens go to every executor. A document that shares seeds
with an item is tiled in the task that reads it: seeds that follow each other on a diagonal
are maximal matches, the longest unmarked match is marked again and again, and the item's
covered part decides. The order of the tiles doesn't matter, so reordered passages count.
"""

from __future__ import annotations

import functools
import heapq
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.llm import vec
from inkwell.scratch import bounded_batches

#: Shortest tile in tokens (shorter items: the whole item), and the covered part of an item
#: from which a document counts as contaminated.
TILE, COVERAGE = 5, 0.6
#: Characters of the benchmark from which no item more is broadcast at once.
BLOCK_CHARS = 16_000_000
#: Most shared seeds that are held at once, unless one document and one item share more.
SEEDS = 4_000_000


#: Scripts that are written without spaces, as ranges of code points: each character is a token.
_SINGLE = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))


def _kind(point: int) -> int:
    """0: apart from tokens, 1: part of one (letters, marks and numbers), 2: one by itself."""
    if any(a <= point <= b for a, b in _SINGLE) and unicodedata.category(chr(point))[0] in "LMN":
        return 2
    return int(unicodedata.category(chr(point))[0] in "LMN")


@functools.cache
def _plane() -> np.ndarray:
    return np.array([_kind(i) for i in range(1 << 16)], np.uint8)


def _kinds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: whether it is part of a token, and whether a token starts there whatever comes before it."""
    inside = ~vec.PROSE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    lead = np.flatnonzero(raw >= 0xC0)
    if not len(lead):
        return inside, cut[:-1]
    first = raw[lead].astype(np.int64)
    size = np.where(first < 0xE0, 2, np.where(first < 0xF0, 3, 4))
    point = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    for k in (1, 2, 3):
        here = size > k
        point[here] = point[here] << 6 | (raw[np.minimum(lead[here] + k, len(raw) - 1)] & 0x3F)
    kind = _plane()[np.minimum(point, 0xFFFF)]
    if (far := np.flatnonzero(point > 0xFFFF)).size:
        some, which = np.unique(np.minimum(point[far], 0x10FFFF), return_inverse=True)
        kind[far] = np.array([_kind(int(x)) for x in some], np.uint8)[which]
    apart = kind == 0
    for k in range(4):
        at = lead[apart & (size > k)] + k
        inside[at[at < len(raw)]] = False
    single = kind == 2
    cut[lead[single]] = True
    cut[np.minimum(lead[single] + size[single], len(raw))] = True
    return inside, cut[:-1] & inside


def _tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, token hashes and each text's first token, by block of whole texts."""
    for i, _, raw, at in vec.blocks(texts):
        inside, cut = _kinds(raw)
        edge = at[1:-1]
        cut[edge[edge < len(raw)]] = True
        starts = np.flatnonzero(inside & (cut | ~np.r_[False, inside[:-1]]))
        ends = np.flatnonzero(inside & ~(np.r_[inside[1:], False] & ~np.r_[cut[1:], True])[: len(inside)]) + 1
        yield i, vec.word_hashes(raw, starts, ends), np.searchsorted(starts, at)


class Seeds:
    """The hashes of all windows of K tokens of a block of items, for each K that occurs."""

    def __init__(self, texts: list[str], tile: int):
        self.sizes = np.zeros(len(texts), np.int64)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for i, token, first in _tokens(pa.array(texts, pa.string())):
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                self.sizes[i + k] = b - a
                if b > a:
                    width = min(tile, int(b - a))
                    gram = vec.GRAMS.windows(vec.GRAMS.prefix(token[a:b]), width)
                    parts.setdefault(width, []).append((gram, np.full(len(gram), i + k), np.arange(len(gram))))
        self.by_width = {}
        for width, found in parts.items():
            gram, item, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((at, item, gram))
            gram, item, at = gram[order], item[order], at[order]
            seen = np.zeros(1 << 22, bool)
            seen[gram >> vec.U(42)] = True
            first = np.r_[0, np.flatnonzero(gram[1:] != gram[:-1]) + 1]
            # Places of a gram in an item are found by one number: the gram's run, then the item.
            run = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(gram)]))
            self.by_width[width] = gram[first], run * (len(texts) + 1) + item, item, at, seen

    def hits(self, token: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Owner, item, token position and item position of every shared seed, whole pairs at a time.

        No more than SEEDS are yielded at once: documents with more are taken by ranges of items.
        """
        gram, keyed, item, at, seen = self.by_width[width]
        mine = vec.GRAMS.windows(vec.GRAMS.prefix(token), width)
        here = np.flatnonzero(seen[mine >> vec.U(42)])
        here = here[owner[here] == owner[here + width - 1]]
        run = np.searchsorted(gram, mine[here])
        known = gram[np.minimum(run, len(gram) - 1)] == mine[here]
        here, run = here[known], run[known]
        n = len(self.sizes)

        def part(low: int, high: int, a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            # Seeds ``low`` to ``high`` of the documents with items a to b.
            lo, hi = (np.searchsorted(keyed, run[low:high] * (n + 1) + x) for x in (a, b))
            count = hi - lo
            total, rows = int(count.sum()), owner[here[low:high]]
            if not total:
                return
            if total > SEEDS and rows[0] != rows[-1]:
                edge = np.flatnonzero(np.diff(rows)) + 1
                cut = low + int(edge[len(edge) // 2])
                yield from part(low, cut, a, b)
                yield from part(cut, high, a, b)
            elif total > SEEDS and b - a > 1:
                yield from part(low, high, a, (a + b) // 2)
                yield from part(low, high, (a + b) // 2, b)
            else:
                position = np.repeat(here[low:high], count)
                which = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
                yield owner[position], item[which], position, at[which]

        yield from part(0, len(here), 0, n)


_built: dict[str, Seeds] = {}


def _seeds(name: str, texts: list[str], tile_size: int) -> Seeds:
    """The seeds of a block, built once in a worker's life."""
    if name not in _built:
        _built.clear()
        _built[name] = Seeds(texts, tile_size)
    return _built[name]


def tile(p: np.ndarray, q: np.ndarray, n: int, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (p, q, length) from seed positions in a text and in an item of ``n`` tokens."""
    order = np.lexsort((q, p - q))
    p, q = p[order], q[order]
    new = np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1)]
    begin = np.flatnonzero(new)
    length = np.diff(np.r_[begin, len(p)]) + least - 1
    heap = [(-int(m), int(b), int(a)) for m, a, b in zip(length, p[begin], q[begin], strict=True)]
    heapq.heapify(heap)
    base, size = int(p.min()), int(p.max() - p.min()) + least
    item, text, tiles, free = np.zeros(n, bool), np.zeros(size, bool), [], n
    while heap and free >= least:
        m, b, a = heapq.heappop(heap)
        m = -m
        marked = item[b : b + m] | text[a - base : a - base + m]
        if not marked.any():
            item[b : b + m] = text[a - base : a - base + m] = True
            tiles.append((a, b, m))
            free -= m
            continue
        for s, e in zip(*vec.runs(~marked), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (-int(e - s), b + int(s), a + int(s)))
    return tiles


def matches(texts: pa.Array, seeds: Seeds, least: int, coverage: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
    """Row, item, coverage and tiles of each contaminated pair."""
    for i, token, first in _tokens(texts):
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for width in seeds.by_width:
            if len(token) < width:
                continue
            for row, item, p, q in seeds.hits(token, owner, width):
                order = np.lexsort((p, q, item, row))
                row, item, p, q = row[order], item[order], p[order], q[order]
                edge = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(item) != 0)])
                # Tiles cover no more than the seeds do.
                reach = np.r_[np.where((np.diff(row) != 0) | (np.diff(item) != 0), width, np.minimum(np.diff(q), width)), width]
                most = np.add.reduceat(reach, edge)
                wide = most >= coverage * seeds.sizes[item[edge]]
                for a, b in zip(edge[wide].tolist(), np.r_[edge[1:], len(row)][wide].tolist(), strict=True):
                    n = int(seeds.sizes[item[a]])
                    tiles = tile(p[a:b] - first[row[a]], q[a:b], n, width)
                    part = sum(t[2] for t in tiles) / n
                    if part >= coverage:
                        yield i + int(row[a]), int(item[a]), part, tiles


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, tile_size: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and lower-case texts of the benchmark, by blocks that end at BLOCK_CHARS."""
    rows = benchmark.select(F.col(f"`{item_col}`").alias("id"), F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("text"))
    held, size = [], 0
    for row in rows.where(F.length("text") > 0).toLocalIterator():
        held.append(row)
        size += len(row.text)
        if size >= BLOCK_CHARS:
            yield _sorted(held)
            held, size = [], 0
    if held:
        yield _sorted(held)


def _sorted(rows: list) -> tuple[list, list[str]]:
    rows = sorted(rows, key=lambda r: (r.id is None, r.id, r.text))
    return [r.id for r in rows], [r.text for r in rows]


def find(docs: DataFrame, benchmark: DataFrame, tile_size: int = TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per contaminated (row of ``docs``, item): ids, coverage, n_tiles, longest, tiles.

    Tokens are runs of letters, marks and numbers of any script in lower case; a Han or kana character is a
    token by itself, and all other characters stand apart. Tiles are (token position in the
    text, in the item, length). Null and empty texts and items never match; null ids are
    reported as they are; repeated rows and items are matched each on their own; an empty
    benchmark or table gives no rows. Map-only over ``docs``, once per benchmark block.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    item_kind, item_type = benchmark.schema[item_col].dataType.simpleString(), to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {item_kind}, coverage double, n_tiles long, longest long, tiles array<struct<doc_token:long,item_token:long,length:long>>"
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    out = None
    for ids, texts in _blocks(benchmark, item_col, item_text_col, tile_size):
        shared, name = spark.sparkContext.broadcast((ids, texts)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            ids, texts = shared.value
            seeds = _seeds(name, texts, tile_size)
            tiles_type = pa.list_(pa.struct([("doc_token", pa.int64()), ("item_token", pa.int64()), ("length", pa.int64())]))
            for batch in batches:
                found = list(matches(batch.column(1), seeds, tile_size, coverage))
                tiles = [[dict(zip(("doc_token", "item_token", "length"), t, strict=True)) for t in sorted(x[3])] for x in found]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([x[0] for x in found], pa.int64())), pa.array([ids[x[1]] for x in found], item_type), pa.array([x[2] for x in found], pa.float64()),
                    pa.array([len(x[3]) for x in found], pa.int64()), pa.array([max(t[2] for t in x[3]) for x in found], pa.int64()), pa.array(tiles, tiles_type),
                ], [id_col, item_col, "coverage", "n_tiles", "longest", "tiles"])
            vec.release()

        part = slim.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, tile_size: int = TILE, coverage: float = COVERAGE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns under any names, that no item contaminates.

    Rows with null or empty texts stay, as do all where the benchmark is empty or has only null
    and empty items; null and repeated ids and repeated rows are judged each on their own
    text, so copies go or stay together; an empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    for _, texts in _blocks(benchmark, item_col, item_text_col, tile_size):
        shared, name = docs.sparkSession.sparkContext.broadcast(texts), uuid.uuid4().hex
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name, names=docs.columns) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(name, shared.value, tile_size)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in matches(batch.column(batch.num_columns - 1), seeds, tile_size, coverage)]] = False
                yield batch.select(range(batch.num_columns - 1)).rename_columns(names).filter(pa.array(keep))
            vec.release()

        # The lower-case text comes last and is found by its place, whatever the columns' names.
        folded = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select("*", F.lower(F.col(f"c{at}").cast("string")).alias("folded"))
        docs = folded.mapInArrow(run, docs.schema)
    return docs
