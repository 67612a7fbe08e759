"""Suffix-array deduplication of byte strings by longest previous factors (operator 4).

The suffixes of a group are sorted, and for each place the nearest smaller places before and
after it in suffix order give the longest previous factor: what starts there and also starts
earlier. Keeping the first copy removes what a previous factor of the window's length or more
covers. Keeping none also removes what a longest next factor covers, the same array read with
the places in reverse.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import repeats, suffixes, vec

WINDOW = 400


def factors(text: np.ndarray, ends: np.ndarray, t: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places with a match of ``t`` bytes or more, and their longest previous and longest next factors (0: below t)."""
    place, lcp, runs = suffixes.Suffixes(text, ends, t).neighbours()
    return place, suffixes.longest_previous(place, lcp, runs), suffixes.longest_previous(-place, lcp, runs)


def search(text: np.ndarray, ends: np.ndarray, first: bool, t: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of repeats of ``t`` bytes or more; ``first``: of those that occur earlier."""
    place, previous, following = factors(text, ends, t)
    length = previous if first else np.maximum(previous, following)
    return place[length > 0], length[length > 0]


def dedup(docs: DataFrame, keep: str = "first", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes, n_removed, spans (removed runs) and kept (binary).

    Removes every UTF-8 byte covered by a string of ``window`` bytes that also starts at an
    earlier place (``keep='first'``; places are ordered by id, null first, then a content hash,
    then offset) or at any other (``keep='none'``). Strings lie in one text and are judged on
    the input; copies within a text and overlapping ones count. A null text counts as empty
    and keeps nothing; ids may be null; rows that repeat both id and text are copies of each
    other, and with ``keep='first'`` share one answer; other columns are not carried; an empty
    table gives no rows. ``window`` is at least 16.
    """
    if window < 16 or keep not in ("first", "none"):
        raise ValueError("window must be 16 or more, keep 'first' or 'none'")

    def find(text, ends, first):
        return search(text, ends, first, window)

    def finish(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple:
        gone = vec.covered(len(raw), start, end)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        return len(raw), len(raw) - len(kept), [{"start": int(a), "end": int(b)} for a, b in zip(*vec.runs(gone), strict=True)], kept

    corpus = repeats.Corpus(docs, window, repeats.byte_units, find, keep == "first", id_col, text_col, "suffixes")
    out = corpus.rewritten(finish, "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary", ["n_bytes", "n_removed", "spans", "kept"], pa.binary())
    return out.withColumnRenamed("id", id_col)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return rows.select(F.col(f"`{id_col}`"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), repeats.sha256("kept").alias("kept_sha256"))
