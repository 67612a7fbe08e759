"""Quality classifier by naive Bayes support vectors (operator 12).

A text is the set of its n-grams: of 1 to 4 bytes, and of 1 to 3 marks of how far back each word
last stood (which shows stuttering whatever the words are). N-gram indicators are hashed to
2**BITS places and scaled by the log-count ratio of their place between the two classes,
counted over all labelled rows; a linear hinge-loss model is fitted to these vectors by dual
coordinate descent on a bounded sample of texts. Scoring is map-only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, bounded_batches

BITS = 18
#: Bytes of the n-grams of a text; words of the n-grams of marks.
ORDERS, MARKS = (1, 2, 3, 4), (1, 2, 3)
#: Most different texts of a class that the model is fitted to, and most n-grams of all of them.
SAMPLE, NGRAMS = 4096, 24_000_000
#: Smoothing of the counts; cost of a unit of hinge loss; passes over the sample; least change of a pass that goes on.
ALPHA, COST, PASSES, STILL = 1.0, 1.0, 20, 1e-3
#: Bytes of a text that are cut into n-grams at once.
PIECE = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.array([1, 2, 3, 5, 17, 65])


class Weights(NamedTuple):
    """Ratios by place, the model's weights by place, and the bias."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float


def _place(gram: np.ndarray) -> np.ndarray:
    return ((gram * _SPREAD) >> np.uint64(64 - BITS)).astype(np.int32)


def _grams(units: np.ndarray, orders: tuple[int, ...], bits: int, tag: int) -> list[np.ndarray]:
    """Places of the n-grams of ``units`` (each below 2**bits)."""
    out, gram = [], np.zeros(0, np.uint64)
    for n in range(1, max(orders) + 1):
        m = len(units) - n + 1
        if m <= 0:
            break
        gram = units[:m].copy() if n == 1 else (gram[:m] << np.uint64(bits)) | units[n - 1 :]
        if n in orders:
            out.append(_place(gram + np.uint64((tag + n) << 40)))
    return out


def _marks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word how far back in its text it last stood, in classes (0: nowhere); each text's first word."""
    starts, ends, first = vec.words(raw, at)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    word = vec.word_hashes(raw, starts, ends)
    order = np.lexsort((np.arange(len(word)), word, owner))
    again = np.flatnonzero((word[order[1:]] == word[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]]))
    back = np.zeros(len(word), np.int64)
    back[order[1:][again]] = order[1:][again] - order[:-1][again]
    return np.searchsorted(_FAR, back, "right").astype(np.uint64), first


class Places:
    """Distinct places of the n-grams of texts; keeps one table for all of them."""

    def __init__(self) -> None:
        self._last = np.zeros(1 << BITS, np.int32)

    def _distinct(self, places: np.ndarray) -> np.ndarray:
        at = np.arange(len(places), dtype=np.int32)
        self._last[places] = at
        return places[self._last[places] == at]

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """One array a text, sorted; a null or empty text has only its length's place."""
        for i, j, raw, at in vec.blocks(texts):
            mark, first = _marks(raw, at)
            for k in range(j - i):
                text, marks = raw[at[k] : at[k + 1]], mark[first[k] : first[k + 1]]
                found = [self._distinct(np.concatenate(x)) for p in range(0, len(text), PIECE) if (x := _grams(text[p : p + PIECE + max(ORDERS) - 1].astype(np.uint64), ORDERS, 8, 0))]
                found += [self._distinct(np.concatenate(x)) for p in range(0, len(marks), PIECE) if (x := _grams(marks[p : p + PIECE + max(MARKS) - 1], MARKS, 8, 16))]
                found.append(_place(np.array([(32 << 40) + len(marks).bit_length()], np.uint64)))
                yield np.sort(self._distinct(np.concatenate(found)))


def ratios(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log-count ratio by place, from the numbers of texts of either class that have it."""
    p, q = ones + ALPHA, zeros + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def _norm(scaled: np.ndarray) -> float:
    return max(float(np.sqrt((scaled * scaled).sum())), 1e-12)


def descend(texts: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised hinge-loss model by dual coordinate descent.

    Vectors have length 1 and a constant 1 beside them for the bias. Both classes weigh the same in sum.
    """
    weight, bias = np.zeros(len(ratio)), 0.0
    sign = np.where(labels > 0, 1.0, -1.0)
    each = {s: COST * len(sign) / (2 * max(int((sign == s).sum()), 1)) for s in (1.0, -1.0)}
    dual, rng = np.zeros(len(sign)), np.random.default_rng(7)
    size = [_norm(ratio[x]) for x in texts]
    for _ in range(PASSES):
        most = 0.0
        for i in rng.permutation(len(sign)):
            places = texts[i]
            vector = ratio[places] / size[i]
            gradient = sign[i] * (weight[places] @ vector + bias) - 1
            new = min(max(dual[i] - gradient / 2, 0.0), each[sign[i]])
            step = new - dual[i]
            if step:
                weight[places] += step * sign[i] * vector
                bias += step * sign[i]
                dual[i], most = new, max(most, abs(step))
        if most < STILL:
            break
    return weight, bias


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> DataFrame:
    """Texts (``t``) and labels (``y``, 0 or 1) of the rows whose id has one label.

    Null ids and labels, and ids with two labels, teach nothing; rows of one id all teach.
    """
    col = lambda name: F.col(f"`{name}`")
    known = labels.select(col(id_col).alias("id"), (col(label_col) == 1).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other").drop("other")
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("t")).where("id is not null")
    return texts.join(known.hint("merge"), "id").select("t", "y")


def train(rows: DataFrame, sample: int = SAMPLE, ngrams: int = NGRAMS) -> Weights:
    """A model from rows of ``t`` and ``y``.

    Counts are those of all rows, copies included. The model is fitted to at most ``sample`` different texts of a
    class, those of the lowest content hash in each of as many hash slots, in the order of that hash
    until they have ``ngrams`` n-grams; it doesn't depend on the order of rows. With rows of one class only all
    texts belong to it; without rows all scores are 0.5.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "classifier")
    rows = scratch.table(rows.select("t", "y", F.xxhash64("t").alias("h")), "rows")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, n = Places(), np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in batches:
            for y, x in zip(batch.column(1).to_numpy(), places.of(batch.column(0)), strict=True):
                n[y][x] += 1
                n[y][-1] += 1
        some = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0][some]), pa.array(n[1][some])], ["place", "zeros", "ones"])
        vec.release()

    # Each task sends at most a row a place; so does the sum.
    counts = rows.select("t", "y").mapInArrow(count, "place long, zeros long, ones long").groupBy("place").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    at = counts.column("place").to_numpy()
    n[0][at], n[1][at] = counts.column("zeros").to_numpy(), counts.column("ones").to_numpy()
    ratio, none = ratios(n[1][:-1], n[0][:-1]), np.zeros(1 << BITS)
    if not n[:, -1].all():
        scratch.remove()
        return Weights(none, none, float(np.sign(n[1][-1] - n[0][-1])))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            found = [x.tobytes() for x in places.of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([len(x) // 4 for x in found], pa.int64()), pa.array(found, pa.binary())], ["y", "h", "n", "places"])
        vec.release()

    slots = rows.withColumn("slot", F.pmod("h", F.lit(sample)))
    lowest = scratch.table(slots.groupBy("y", "slot").agg(F.min("h").alias("h")), "lowest")  # at most two rows a slot
    texts = slots.join(F.broadcast(lowest), ["y", "slot", "h"]).groupBy("y", "slot").agg(F.first("t").alias("t"), F.first("h").alias("h"))
    cuts = scratch.table(texts.select("t", "y", "h").mapInArrow(cut, "y int, h long, n long, places binary"), "sample")
    upto, last = 0, None
    for r in sorted(cuts.select("h", "y", "n").collect()):
        upto += r.n
        if upto > ngrams and last is not None:
            break
        last = r.h
    kept = sorted((r.h, r.y, r.places) for r in cuts.where(F.col("h") <= last).toLocalIterator())
    scratch.remove()
    weight, bias = descend([np.frombuffer(x, np.int32) for _, _, x in kept], np.array([y for _, y, _ in kept]), ratio)
    return Weights(ratio, weight, bias)


def scores(texts: pa.Array, model: Weights, places: Places) -> np.ndarray:
    """0 to 1 by text; 0.5 on the model's boundary."""
    both, square = model.ratio * model.weight, model.ratio**2
    margin = np.array([both[x].sum() / max(np.sqrt(square[x].sum()), 1e-12) for x in places.of(texts)])
    return 1 / (1 + np.exp(-2 * (margin + model.bias)))


def score(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``score`` and ``predicted`` (1 from 0.5 on).

    Null texts score as empty ones, by their length and the bias; copies score alike; null and repeated
    ids keep their rows; other columns aren't carried; an empty table gives no rows. Map-only; whole texts in blocks.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            found = scores(batch.column(1), shared.value, places)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])
        vec.release()

    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
