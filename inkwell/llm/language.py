"""Language identification by compression (operator 9).

Each language has a raw-content zstandard dictionary cut from a bounded sample of labelled
texts. A text goes, block by block, through one compressor per language; the language whose
dictionary makes it smallest wins, and a narrow margin over the runner-up is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, bounded_batches

#: Bytes of the dictionary of one language, and of one text's share in it; together they
#: bound what training gathers on the driver.
DICTIONARY, SHARE = 112 * 1024, 2048
#: Most languages that are learned.
LANGUAGES = 400
#: A text is encoded in blocks of so many bytes, so that the dictionary has a say in all of it.
BLOCK = 2048
#: The match finder of every compressor: short matches matter more than speed here.
_FINDER = {"window_log": 18, "chain_log": 17, "hash_log": 17, "search_log": 3, "min_match": 4, "strategy": zstandard.STRATEGY_LAZY}
#: Texts below this many bytes follow a stretch of the language's own sample, so that they
#: share its letter statistics; alone they would be stored as they are by every compressor.
SHORT, LEAD = 512, 1024
#: Rejected: the second-best language costs less than this part more.
MARGIN = 0.004
UNDETERMINED = "und"


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most: int = LANGUAGES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from rows with a language and a text with letters.

    The sample holds, for each language, the text of the lowest content hash in each of
    DICTIONARY / 256 hash slots, and takes them in the order of that hash until DICTIONARY
    bytes are met, a passage of at most SHARE bytes of each from where its hash says, in lower
    case; it doesn't depend on the order of rows. Languages with more rows come first, then by name. Null languages and texts teach nothing; an empty table gives no dictionary; more than
    ``most`` languages are refused, for each costs a dictionary on the driver and a compressor a text.
    """
    slots = DICTIONARY // 256
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.where(F.col(f"`{lang_col}`").isNotNull() & text.rlike(r"\p{L}")).select(F.col(f"`{lang_col}`").cast("string").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"))
    slim = slim.withColumn("slot", F.pmod("h", F.lit(slots)))
    # The lowest hash of each slot, reduced on the map side whatever a language's share of the rows.
    lowest = slim.groupBy("k", "slot").agg(F.min("h").alias("h"), F.count("*").alias("n"))
    lowest = Scratch(docs.sparkSession, "language").table(lowest, "lowest")
    if lowest.select("k").distinct().count() > most:
        raise ValueError(f"more than {most} languages: clean the labels or raise the bound")
    # At most slots rows of 40 bytes a language, so no text is shuffled.
    length = F.greatest(F.length("t") - F.lit(SHARE - 1), F.lit(1))
    passage = F.substring("t", (F.lit(1) + F.pmod(F.shiftrightunsigned("h", 20), length)).cast("int"), F.lit(SHARE))
    rows = slim.join(F.broadcast(lowest), ["k", "slot", "h"]).select("k", "slot", "h", "n", passage.alias("t")).dropDuplicates(["k", "slot"])
    texts: dict[str, list[tuple[int, str]]] = {}
    rows_of: dict[str, int] = {}
    for row in rows.toLocalIterator():
        texts.setdefault(row.k, []).append((row.h, row.t.lower()))
        rows_of[row.k] = rows_of.get(row.k, 0) + row.n
    out: dict[str, bytes] = {}
    for lang, found in texts.items():
        joined = bytearray()
        for _, t in sorted(found):
            joined += t.encode()[:SHARE].decode(errors="ignore").encode() + b"\n"
            if len(joined) >= DICTIONARY:
                break
        out[lang] = bytes(joined[:DICTIONARY])
    return dict(sorted(out.items(), key=lambda x: (-rows_of[x[0]], x[0])))


class Model:
    """One language's compressor."""

    def __init__(self, lang: str, raw: bytes):
        self.lang = lang
        params = zstandard.ZstdCompressionParameters(write_checksum=False, write_content_size=False, write_dict_id=False, **_FINDER)
        self.lead, rest = (raw[-LEAD:], raw[:-LEAD]) if len(raw) > 2 * LEAD else (raw[len(raw) // 2 :], raw[: len(raw) // 2])
        content = zstandard.ZstdCompressionDict(rest.rjust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(compression_params=params)
        self._compress = zstandard.ZstdCompressor(compression_params=params, dict_data=content).compress
        self._own = len(self._compress(self.lead))

    def cost(self, text: bytes) -> int:
        """Compressed bytes of a whole text, block by block."""
        if len(text) < SHORT:
            return len(self._compress(self.lead + text)) - self._own
        return sum(len(self._compress(text[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def classify(texts: pa.Array, models: list[Model]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and rejection of each text."""
    lang, score, rejected = [], np.zeros(len(texts)), np.ones(len(texts), bool)
    for i, text in enumerate(texts.to_pylist()):
        if not models or text is None or not any(map(str.isalpha, text)):
            lang.append(UNDETERMINED)
            continue
        raw = text.lower().encode()
        costs = [model.cost(raw) for model in models]
        best, second = sorted(costs)[:2] if len(costs) > 1 else (costs[0], costs[0] * 2)
        margin = (second - best) / max(second, 1)
        lang.append(models[costs.index(best)].lang)
        score[i] = min(1.0, max(0.0, margin) / (10 * MARGIN))
        rejected[i] = margin < MARGIN
    return lang, score, rejected


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred``, ``score`` and ``rejected``.

    ``und`` (score 0, rejected) for null texts, texts without a letter, and where nothing was
    learned. Ties go to the language with more learned rows, then by name. Map-only; whole texts in blocks.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(lang, raw) for lang, raw in shared.value.items()]
        for batch in batches:
            lang, score, rejected = classify(batch.column(1), models)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [id_col, "lang_pred", "score", "rejected"])
        vec.release()

    slim = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, rejected boolean")


def known(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns under any names, whose language is not rejected.

    Null texts and texts without a letter go; rows of null or repeated ids and repeated rows are
    judged each on their own text; an empty table stays empty. Where nothing was learned (no
    row has a language and letters) no row can be judged, and all stay.
    """
    if not dictionaries:
        return docs
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Model(lang, raw) for lang, raw in shared.value.items()]
        for batch in batches:
            yield batch.rename_columns(names).filter(pa.array(~classify(batch.column(at), models)[2]))
        vec.release()

    # Columns are found by their places, whatever their names.
    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, docs.schema)


def learning_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows to learn from: crc32 of the id as text, modulo 3, is not 1; rows of null ids teach nothing, equal ids go together."""
    return docs.where(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(3)) != 1)
