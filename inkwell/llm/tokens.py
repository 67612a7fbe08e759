"""Token ids in seekable zstandard files (operator 1).

A file is a run of independent zstandard frames, each with the checksum of its content, then
a skippable frame that says which frames hold which document, then the seek table of the
public seekable format (sizes and XXH64 checksums of all frames). A reader takes the tail of
the file and decompresses only the frames of the documents it was asked for.
"""

from __future__ import annotations

import functools
import json
import os
import string
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import vec
from inkwell.scratch import Scratch, parallelism

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Most bytes of ids in a frame; a longer document takes several frames.
FRAME = 1 << 22
#: Words of a generation that a worker remembers (it keeps two), and the longest of them in bytes.
REMEMBERED, WORD = 400_000, 64
#: Marks that a tokenizer keeps apart from the letters before them (an apostrophe may join them).
MARKS = string.punctuation.replace("'", "")


class Encoder:
    """Ids of whole texts. Words repeat, so their ids are kept; no id crosses ASCII white space.

    That holds for tokenizers whose pre-tokenizer drops white space, which is tried out here;
    all others get whole texts, as with ``whole=True``.
    """

    def __init__(self, path: str, end_id: int, whole: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if max(self.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else "<u4")
        self.end, self.whole, self.known, self.older = np.array([end_id], self.width).tobytes(), whole or not self._splits(), {}, {}

        probe = [e.ids for e in self.tokenizer.encode_batch(["ABC XYZ", "abc xyz"], add_special_tokens=False)]
        self.folds = probe[0] == probe[1]  # ASCII case is lost anyway: fewer words to remember
        self.bare = self._bare(path) if self.folds else None
        self.letters: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _splits(self) -> bool:
        """Whether words have the ids that they have in a text, whatever ASCII white space is around them."""
        if any(c.isspace() for token in self.tokenizer.get_added_tokens_decoder().values() for c in token.content):
            return False
        words = ["a", "The", "it's", "x1", "2024", "...", "(b)", "é", "漢字", "'s", "-", "hello", "😀", "aaaa", "e\u0301"]
        alone = dict(zip(words, self._encode(words), strict=True))
        probes, want = [], []
        for gap in [" ", "\t", "\n", "\x0b", "\x0c", "\r", "  ", "\n\n", " \n", "\r\n", "   \t"]:
            for i, word in enumerate(words):
                for lead, tail in (("", ""), (gap, ""), ("", gap)):
                    other = words[(7 * i + 3) % len(words)]
                    probes.append(f"{lead}{word}{gap}{other}{tail}")
                    want.append(alone[word] + alone[other])
        return self._encode(probes) == want and not any(self._encode([" ", "\n", "\t\t"]))

    @staticmethod
    def _bare(path: str):
        """The tokenizer without what does nothing to a lower-case word of letters, or None.

        That is so where the normalizer only composes, folds case and white space, and the
        pre-tokenizer keeps runs of letters whole and apart from runs of marks.
        """
        from tokenizers import Tokenizer, pre_tokenizers

        found = Tokenizer.from_file(path)
        setup = json.loads(found.to_str())
        kinds = [x["type"] for x in (setup["normalizer"] or {}).get("normalizers", [])]
        steps = (setup["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = "".join(x["pattern"].get("Regex", "") for x in steps if x["type"] == "Split")
        if kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"] or not pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
            return None
        found.normalizer = None
        found.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return found

    def _encode(self, texts: list[str], tokenizer=None) -> list[bytes]:
        kind = "H" if self.width.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, new: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word; a lower-case word of letters and the marks behind it are encoded apart."""
        joined = b"\n".join(new).decode()
        texts = joined.split("\n")
        if self.bare is None or not unicodedata.is_normalized("NFC", joined):
            return dict(zip(new, self._encode(texts), strict=True))
        cores = [t.rstrip(MARKS) for t in texts]
        easy = [c.isalpha() and c.islower() for c in cores]
        if len(self.letters) > REMEMBERED:
            self.letters = {}
        known = self.letters
        letters = [c for c in dict.fromkeys(compress(cores, easy)) if c not in known]
        known.update(zip(letters, self._encode(letters, self.bare), strict=True))
        hard = [t for t, x in zip(texts, easy, strict=True) if not x]
        known_hard = iter(self._encode(hard))
        tails = [t[len(c) :] for t, c in zip(texts, cores, strict=True)]
        marks = list(set(compress(tails, easy)))
        of_marks = dict(zip(marks, self._encode(marks), strict=True))
        return {w: known[c] + of_marks[m] if x else next(known_hard) for w, c, m, x in zip(new, cores, tails, easy, strict=True)}

    def documents(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text with the end id, as bytes of ``width``; null counts as empty."""
        for i, j, raw, at in vec.blocks(texts):
            if self.whole:
                for ids in self._encode([t or "" for t in texts.slice(i, j - i).to_pylist()]):
                    yield ids + self.end
                continue
            data = raw.tobytes()
            if self.folds and b"<|" not in data:  # special tokens are matched before letters are folded
                data = data.lower()
            split = [data[at[k] : at[k + 1]].split() for k in range(j - i)]
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            known = self.known
            found = [list(map(known.get, words)) for words in split]
            holes = [[k for k, ids in enumerate(row) if ids is None] if None in row else () for row in found]
            new = {words[k] for words, gaps in zip(split, holes, strict=True) for k in gaps}
            known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in known]
            if new:
                known.update(self._words(new))
            for words, row, gaps in zip(split, found, holes, strict=True):
                for k in gaps:
                    row[k] = known[words[k]]
                yield b"".join(row) + self.end
            for w in new:
                if len(w) > WORD:
                    del known[w]


@functools.lru_cache(maxsize=1)
def _encoder(path: str, end_id: int, whole: bool) -> Encoder:
    """One encoder for all tasks of a worker: it keeps the words that it has seen."""
    return Encoder(path, end_id, whole)


vec.KEPT["tokens"] = _encoder.cache_clear


class Writer:
    """One file, document by document."""

    def __init__(self, out, width: np.dtype):
        self.out, self.width = out, width
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is None, doc_id or 0, len(self.frames), len(ids) // self.width.itemsize))
        self.tokens += len(ids) // self.width.itemsize
        for i in range(0, max(len(ids), 1), FRAME):
            part = ids[i : i + FRAME]
            packed = self.compressor.compress(part)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
            self.out.write(packed)

    def close(self) -> None:
        docs = np.array(self.docs, np.int64).reshape(-1, 4)
        index = zstandard.compress(struct.pack("<IQ", self.width.itemsize, len(docs)) + docs.T.astype("<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index + struct.pack("<Q", len(index)))
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class Reader:
    """Documents of one file by position; checks the frames that it reads."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        n, _, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable file")
        seek = end - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(-1, 3)
        self.starts = np.r_[0, np.cumsum(self.frames[:, 0].astype(np.int64))]
        (size,) = struct.unpack("<Q", self._at(seek - 8, 8))
        raw = zstandard.decompress(self._at(seek - 8 - size, size))
        self.width, docs = struct.unpack_from("<IQ", raw)
        null, ids, first, tokens = np.frombuffer(raw, "<i8", offset=12).reshape(4, docs)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids, strict=True)]
        self.first, self.tokens = np.r_[first, n], tokens
        self.decompressor = zstandard.ZstdDecompressor()

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document."""
        lo, hi = int(self.first[k]), int(self.first[k + 1])
        packed, out, at = self._at(int(self.starts[lo]), int(self.starts[hi] - self.starts[lo])), [], 0
        for size, plain, check in self.frames[lo:hi].tolist():
            part = self.decompressor.decompress(packed[at : at + size], max_output_size=plain)
            if len(part) != plain or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                raise ValueError(f"document {k}: checksum of a frame differs")
            out.append(part)
            at += size
        return np.frombuffer(b"".join(out), f"<u{self.width}")

    def find(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Only the requested documents."""
        wanted = set(wanted)
        for k, doc in enumerate(self.doc_ids):
            if doc in wanted:
                yield doc, self.ids(k)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order below ``folder`` and return the files' manifest.

    The manifest (part, path, n_docs, n_tokens, start) is the commit record: a repeated or
    lost task writes another file, and only the files that the manifest names count. One
    range shuffle of the texts by id, then content, so that a repeated id can be split too.
    Null ids come first; rows of one id come in the order of a content hash; a null text
    counts as empty and has only the end id; an empty table gives an empty manifest. Other
    columns are not written.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "manifest")
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = slim.repartitionByRange(parallelism(spark), "id", "h").sortWithinPartitions("id", "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
        encoder, out, writer = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = _encoder(tokenizer, end_id, whole)
                fs.create_dir(top, recursive=True)
                out = fs.open_output_stream(f"{top}/{name}", compression=None)
                writer = Writer(out, encoder.width)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.documents(batch.column(1)), strict=True):
                writer.add(doc_id, ids)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_tokens": [writer.tokens]})
        vec.release("tokens")

    files = scratch.table(ordered.select("id", "text").mapInArrow(run, "part long, path string, n_docs long, n_tokens long"), "files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, where = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as source:
                    reader = Reader(source)
                    starts = start + np.r_[0, np.cumsum(reader.tokens)][:-1]
                    for i in range(0, len(reader), 4096):
                        j = min(i + 4096, len(reader))
                        crc = [zlib.crc32(reader.ids(k).astype("<u4").tobytes()) for k in range(i, j)]
                        yield pa.RecordBatch.from_arrays([pa.array(reader.doc_ids[i:j], pa.int64()), pa.array(starts[i:j], pa.int64()), pa.array(reader.tokens[i:j]), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(parallelism(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
