"""Quality rules as a bitmask ledger (operator 7).

Every rule is evaluated once per text. The ledger holds the measurements and one bit per
failed rule and is written as a table; policies are versioned masks over those bits, so a new
policy or an ablation reads the ledger and never a text again. Map-only: no shuffle but the
ablation's few counters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, bounded_batches

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")
GRAM = 5
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LINE = np.arange(256) == 0x0A

#: Rules in bit order: name and failing condition over the measurements. Only ever append.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_heavy": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "stutter": "10 * n_stutters > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def _repeats(owner: np.ndarray, gram: np.ndarray, later: bool = False) -> np.ndarray:
    """Which (owner, gram) pairs occur twice or more; ``later``: all but each first one."""
    order = np.lexsort((gram, owner)) if not later else np.lexsort((np.arange(len(gram)), gram, owner))
    o, g = owner[order], gram[order]
    same = (o[1:] == o[:-1]) & (g[1:] == g[:-1])
    out = np.zeros(len(gram), bool)
    out[order[1:][same]] = True
    if not later:
        out[order[:-1][same]] = True
    return out


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """Measurements of whole texts; a null text has none but zeros."""
    out = {name: np.zeros(len(texts), np.int64) for name in MEASURES}
    for i, j, raw, at in vec.blocks(texts):
        n = j - i
        starts, ends, first = vec.words(raw, at)
        count = np.diff(first)
        owner = np.repeat(np.arange(n), count)
        total = lambda hit: np.diff(np.r_[0, np.cumsum(hit)][at])
        lead = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        out["n_words"][i:j] = count
        out["word_chars"][i:j] = np.bincount(owner, (lead[ends] - lead[starts]), n).astype(np.int64)
        out["n_symbols"][i:j] = total(_SYMBOL[raw])
        prefix = vec.WORDS.prefix(raw)
        word = vec.WORDS.of(prefix, starts, ends)

        if len(word) >= GRAM:
            gram = vec.GRAMS.windows(vec.GRAMS.prefix(word), GRAM)
            at_word = np.flatnonzero(owner[GRAM - 1 :] == owner[: len(gram)])
            twice = at_word[_repeats(owner[at_word], gram[at_word])]
            out["n_repeat_words"][i:j] = np.bincount(owner[vec.covered(len(word), twice, twice + GRAM)], minlength=n)
        stutter = np.flatnonzero((word[1:] == word[:-1]) & (owner[1:] == owner[:-1])) + 1
        out["n_stutters"][i:j] = np.bincount(owner[stutter], minlength=n)

        breaks = np.flatnonzero(_LINE[raw])
        begin = np.sort(np.r_[at[:-1], breaks + 1])
        end = np.sort(np.r_[at[1:], breaks])
        filled = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[filled], end[filled]
        line_owner = np.searchsorted(at, begin, "right") - 1
        out["n_lines"][i:j] = np.bincount(line_owner, minlength=n)
        out["n_dup_lines"][i:j] = np.bincount(line_owner[_repeats(line_owner, vec.WORDS.of(prefix, begin, end), later=True)], minlength=n)
    return out


def failed_bits(rules: dict[str, str] = RULES) -> Column:
    """The ledger's bits, from the measurements."""
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules.values())]
    out = F.lit(0)
    for bit in bits:
        out = out.bitwiseOR(bit)
    return out.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, the measurements and ``failed`` (bits).

    Null and empty texts measure zero (and so fail ``too_few_words``); null ids and repeated
    rows keep their own row; other columns are not carried; an empty table gives no rows.
    Hashes of 64 bits stand for words, windows and lines within one text.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[m]) for m in MEASURES)], [id_col, *MEASURES])

    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{m} long" for m in MEASURES)).withColumn("failed", failed_bits())


def stored(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of ``docs``, written once below ``path`` (or an intermediate folder) and read from there; see ``ledger``."""
    rows = ledger(docs, id_col, text_col)
    if path is None:
        return Scratch(docs.sparkSession, "quality").table(rows, "ledger")
    rows.write.parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def apply_policy(rows: DataFrame, policy: str) -> Column:
    """True where no rule of the policy failed."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: rows that fail it, and rows that only it rejects.

    ``rows`` are a ledger; a text without words fails like any other, copies count each, and the
    rules of an empty ledger have no row. One aggregation to at most 2**rules counters of bit
    patterns, then arithmetic on those.
    """
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[policy]]))
    hit = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return hit.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
    )
