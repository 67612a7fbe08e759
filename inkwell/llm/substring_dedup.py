"""Substring deduplication of word sequences by prefix-partitioned suffix trees (operator 6).

Suffixes are split by prefixes of variable length into groups that fit in memory: the words of
an anchor, and for an anchor that very many suffixes share, nearly a window of words, and then
a whole window, at which length equal prefixes are repeats and are counted. A group's subtrees
are built from suffix order and common prefixes; their internal nodes at the window's depth or
deeper whose leaves differ in the word before them are the maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkwell.llm import repeats, suffixes, vec

WINDOW = 35


def maximal_repeats(words: np.ndarray, ends: np.ndarray, t: int = WINDOW) -> list[tuple[int, np.ndarray]]:
    """Length and places of each maximal repeat of ``t`` words or more: the deep internal nodes that are left-diverse."""
    place, lcp, runs = suffixes.Suffixes(words, ends, t).neighbours()
    depth, first, last, _, _ = suffixes.nodes(place, lcp, runs)
    # Places before which nothing or the end of a segment stands differ from all others.
    starts = np.isin(place, np.r_[0, ends])
    before = words[np.maximum(place - 1, 0)]
    differs = np.cumsum(np.r_[False, (before[1:] != before[:-1]) | starts[1:] | starts[:-1]][: len(place)])
    diverse = np.flatnonzero(differs[last] > differs[first]) if len(place) else np.zeros(0, int)
    return [(int(depth[i]), np.sort(place[first[i] : last[i] + 1])) for i in diverse]


def search(words: np.ndarray, ends: np.ndarray, first: bool, t: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of repeats of ``t`` words or more; ``first``: of those that occur earlier.

    A leaf takes the depth of its parent, the longest repeat that starts there; with ``first``
    the depth of the deepest node that has a lesser leaf. Both are read off while nodes are made.
    """
    place, lcp, runs = suffixes.Suffixes(words, ends, t).neighbours()
    *_, parent, later = suffixes.nodes(place, lcp, runs)
    length = later if first else parent
    return place[length > 0], length[length > 0]


def dedup(docs: DataFrame, keep: str = "first", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, spans (removed runs of words) and kept.

    Words are runs of other characters than space and U+0009 to U+000D, unchanged. Removes
    every word covered by a window whose sequence of words also starts at an earlier place
    (``keep='first'``; places are ordered by id, null first, then a content hash, then
    position) or at any other (``keep='none'``). Windows lie in one text and are judged on the
    input; copies within a text and overlapping ones count. ``kept`` joins the other words by
    one space. A null text has no words; ids may be null; rows that repeat both id and text
    are copies of each other, and with ``keep='first'`` share one answer; other columns are
    not carried; an empty table gives no rows. Hashes of 64 bits stand for words.
    """
    if window < 4 or keep not in ("first", "none"):
        raise ValueError("window must be 4 or more, keep 'first' or 'none'")

    def find(words, ends, first):
        return search(words, ends, first, window)

    def finish(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        words = raw.split()
        gone = vec.covered(len(words), start, end)
        kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if len(start) else words
        return len(words), len(words) - len(kept), [{"start": int(a), "end": int(b)} for a, b in zip(*vec.runs(gone), strict=True)], b" ".join(kept).decode()

    corpus = repeats.Corpus(docs, window, repeats.word_units, find, keep == "first", id_col, text_col, "subtrees")
    out = corpus.rewritten(finish, "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string", ["n_words", "n_removed", "spans", "kept"], pa.string())
    return out.withColumnRenamed("id", id_col)
