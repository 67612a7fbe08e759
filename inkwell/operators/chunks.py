"""Heading-aware chunks with overlap, and lossless splits for translation."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.scratch import bounded_batches, slices

TARGET, OVERLAP, LEAST = 1500, 150, 0.6
ROOT, SEPARATOR = "正文", " › "
SPLIT = 12_000
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_ATOM = re.compile(r"""https?://[^\s)>\]"']+|\d+(?:[.,]\d+)*[%‰]?""")
#: Sentence and paragraph ends at which a chunk may stop (fixed values).
STOPS = ("\n\n", "。", ". ")


def sections(markdown: str) -> Iterator[tuple[str, str]]:
    """(path, body) of each section that has a body. A heading cuts the path to its level and adds itself."""
    path: list[str] = []
    body: list[str] = []
    for line in [*markdown.replace("\r\n", "\n").split("\n"), None]:
        found = _HEADING.match(line) if line is not None else None
        if line is not None and not found:
            body.append(line)
            continue
        joined = "\n".join(body).strip()
        if joined:
            yield SEPARATOR.join(path) or ROOT, joined
        body = []
        if found:
            path = [*path[: len(found[1]) - 1], found[2].strip()]


def pieces(body: str, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[str]:
    """Overlapping parts of a body, cut behind a stop where one lies late enough."""
    start, n = 0, len(body)
    while True:
        end = min(start + target, n)
        if end < n:
            stop = max(body.rfind(s, 0, end + len(s)) for s in STOPS)
            end = stop + 1 if stop > start + int(target * LEAST) else end
        part = body[start:end].strip()
        if part:
            yield part
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def chunked(markdown: str | None, target: int = TARGET, overlap: int = OVERLAP) -> list[tuple[int, str, str]]:
    found = [(path, part) for path, body in sections(markdown or "") for part in (pieces(body, target, overlap) if len(body) > target else [body])]
    return [(i, path, part) for i, (path, part) in enumerate(found, 1)]


def packed(source: str | None, most: int = SPLIT) -> list[str]:
    """Parts of whole paragraphs up to ``most`` characters; longer ones are cut, but not in a link or number."""
    out: list[str] = []
    held: str | None = None
    for paragraph in (source or "").replace("\r\n", "\n").rstrip().split("\n\n"):
        if len(paragraph) <= most:
            joined = f"{held}\n\n{paragraph}" if held else paragraph
            if len(joined) > most:
                out.append(held)
                joined = paragraph
            held = joined
            continue
        if held:
            out.append(held)
        held, spans, at = None, [m.span() for m in _ATOM.finditer(paragraph)], 0
        while at < len(paragraph):
            end = min(at + most, len(paragraph))
            while cut := next((e for s, e in spans if s < end < e), None):
                end = cut
            out.append(paragraph[at:end])
            at = end
    return [*out, held] if held else out


def _exploded(docs: DataFrame, id_col: str, text_col: str, make: Callable[[str | None], list[tuple]], names: list[str], types: list[pa.DataType], ddl: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each tuple that ``make`` gives for a text, with the text's id and the columns in ``keep``."""
    bounded_batches(docs.sparkSession)
    kept = [docs.schema[c] for c in (id_col, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, out = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for part in make(text):
                    rows.append(i)
                    out.append(part)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in names]
            at = pa.array(rows, pa.int64())
            same = [batch.column(k).take(at) for k in (0, *range(2, 2 + len(keep)))]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, *keep, *names])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(F.col(id_col), F.col(text_col), *keep).mapInArrow(run, f"{given}, {ddl}")


def chunk(docs: DataFrame, id_col: str, text_col: str, target: int = TARGET, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """(id, chunk_no, section_path, content), with chunk_id and fingerprint, and the columns of ``docs`` in ``keep``."""
    rows = _exploded(docs, id_col, text_col, lambda t: chunked(t, target, overlap), ["chunk_no", "section_path", "content"], [pa.int32(), pa.string(), pa.string()], "chunk_no int, section_path string, content string", keep)
    return rows.withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit(":"), F.format_string("%03d", "chunk_no"))).withColumn("fingerprint", F.sha2("content", 256))


def split(docs: DataFrame, id_col: str, text_col: str, most: int = SPLIT) -> DataFrame:
    return _exploded(docs, id_col, text_col, lambda t: list(enumerate(packed(t, most))), ["part", "content"], [pa.int32(), pa.string()], "part int, content string")


def corpus_violations(chunks: DataFrame, articles: DataFrame, id_col: str = "id") -> DataFrame:
    """Articles without chunks and chunk ids that repeat."""
    bare = articles.select(id_col).join(chunks.select(id_col), id_col, "left_anti").select(F.col(id_col).cast("string").alias("subject"), F.lit("no chunks").alias("violation"))
    twice = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("chunk_id").alias("subject"), F.lit("repeated chunk id").alias("violation"))
    return bare.unionByName(twice)


def browser_index(chunks: DataFrame, articles: DataFrame, id_col: str = "id") -> DataFrame:
    """Light rows for a browser: the summary is the core view, else the start of the first chunk."""
    parts = chunks.groupBy(id_col).agg(F.count("*").alias("chunk_count"), F.min_by("content", "chunk_no").alias("first_chunk"))
    summary = F.coalesce(F.nullif("core_view", F.lit("")), F.substring("first_chunk", 1, 220), F.lit(""))
    return articles.join(parts, id_col, "left").select(id_col, "title", "publisher", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), summary.alias("summary"))


def nested(rows: DataFrame, articles: DataFrame, id_col: str = "id") -> DataFrame:
    """The corpus as one row an article with all its columns and its chunks in order, ready for ``write_corpus``."""
    mine = [c for c in rows.columns if c not in (id_col, "chunk_no")]
    parts = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("chunk_no", *mine))).alias("chunks"))
    empty = F.array().cast(parts.schema["chunks"].dataType)
    return articles.join(parts, id_col, "left").withColumn("chunks", F.coalesce("chunks", empty))


def write_corpus(corpus: DataFrame, path: str, browser_path: str | None = None) -> DataFrame:
    """Writes the nested corpus as Parquet, and a browser's light rows as lines of JSON; totals of articles and chunks."""
    corpus.write.mode("overwrite").parquet(path)
    written = corpus.sparkSession.read.schema(corpus.schema).parquet(path)
    if browser_path:
        core = F.nullif("core_view", F.lit("")) if "core_view" in written.columns else F.lit(None).cast("string")
        start = F.substring(F.get("chunks", F.lit(0)).getField("content"), 1, 220)
        light = [c for c in written.columns if c not in ("chunks", "evidence", "provenance")]
        rows = written.select(*light, F.coalesce(core, start, F.lit("")).alias("summary"), F.size("chunks").alias("chunk_count"))
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(browser_path)
    return written.agg(F.count("*").alias("articles"), F.coalesce(F.sum(F.size("chunks")), F.lit(0)).alias("chunks"))
