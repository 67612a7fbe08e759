"""Markdown operators over tables: one Arrow pass each, rows out."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import drafts, lexicon, markdown
from inkwell.scratch import bounded_batches, slices

_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def rows_of(docs: DataFrame, inputs: list[str], make: Callable[..., list[tuple]], fields: dict[str, str], id_col: str = "id") -> DataFrame:
    """``make(*inputs)`` of each row, one output row for each tuple; null inputs count as empty."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, out = [], []
            for i, row in enumerate(zip(*(batch.column(k + 1).to_pylist() for k in range(len(inputs))), strict=True)):
                for found in make(*(x or "" for x in row)):
                    at.append(i)
                    out.append(found)
            columns = list(zip(*out, strict=True)) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, _TYPES[t]) for c, t in zip(columns, fields.values(), strict=True))], [id_col, *fields])

    return docs.select(F.col(id_col), *inputs).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"`{n}` {t}" for n, t in fields.items()))


def noise(docs: DataFrame, text_col: str) -> DataFrame:
    """Furniture blocks: line, class, block, and their number among equal ones."""
    from pyspark.sql import Window

    found = rows_of(docs, [text_col], lambda t: markdown.cleaned(t)[1], {"line": "int", "code": "string", "block": "string"})
    same = Window.partitionBy("id", "code", "block")
    return found.withColumn("occurrence", F.row_number().over(same.orderBy("line"))).withColumn("count", F.count("*").over(same))


def style(docs: DataFrame, text_col: str, glossary: dict[str, list[str]] | None = None) -> DataFrame:
    return rows_of(docs, [text_col], lambda t: markdown.style(t, glossary), {"code": "string", "line": "int", "column": "int", "item": "string"})


def structures(docs: DataFrame, text_col: str) -> DataFrame:
    return rows_of(docs, [text_col], markdown.structures, {"kind": "string", "signature": "string", "line": "int"})


def facts(docs: DataFrame, text_col: str) -> DataFrame:
    return rows_of(docs, [text_col], markdown.facts, {"number": "string", "qualifier": "string", "block": "int", "line": "int"})


def drift(docs: DataFrame, before: str, after: str) -> DataFrame:
    return rows_of(docs, [before, after], markdown.drift, {"issue": "string", "item": "string", "n": "int"})


def polished(docs: DataFrame, original: str, before: str, after: str, glossary: dict[str, list[str]] | None = None) -> DataFrame:
    return rows_of(docs, [original, before, after], lambda o, b, a: markdown.polished(o, b, a, glossary), {"issue": "string", "item": "string", "n": "int"})


def anchors(docs: DataFrame, text_col: str) -> DataFrame:
    """Numbers with their qualifiers: own ones, cued ones within reach, and those that a table or caption shares (number ``shared``)."""
    make = lambda t: [(a.number, a.qualifier, a.item, a.group, a.line, a.column) for a in drafts.Draft(t).anchors]
    return rows_of(docs, [text_col], make, {"number": "string", "qualifier": "string", "item": "string", "block": "int", "line": "int", "column": "int"})


def issues(docs: DataFrame, original: str, before: str, edited: str) -> DataFrame:
    """What an edit lost against both baselines: code, line, column, item, detail."""
    return rows_of(docs, [original, before, edited], drafts.issues, {"code": "string", "line": "int", "column": "int", "item": "string", "detail": "string"})


def review(docs: DataFrame, original: str, before: str, edited: str, glossary: dict[str, list[str]] | None = None) -> DataFrame:
    """One row a text: issues, style risks, furniture left out of the baseline, the ratio of lengths, and whether a look is needed."""

    def make(o: str, b: str, e: str) -> list[tuple]:
        original, before, edited = drafts.drafted(o, b, e)
        ratio, risks = drafts.lengths(before, e), len(markdown.style(e, glossary))
        odd = ratio is None or not lexicon.LENGTHS[0] <= ratio <= lexicon.LENGTHS[1]
        return [(len(drafts.lost(original, before, edited)), risks, len(before.cleaned()[1]), ratio, odd, odd or risks > 0)]

    return rows_of(docs, [original, before, edited], make, {"issues": "int", "risks": "int", "removed": "int", "ratio": "double", "odd_length": "boolean", "needs_review": "boolean"})


def label_distances(docs: DataFrame, left: str, right: str) -> DataFrame:
    """Edit distance of two labels folded to compatible forms without marks, over the longer one's length."""
    return rows_of(docs, [left, right], lambda a, b: [(drafts.folded(a), drafts.folded(b), drafts.distance(a, b))], {"left": "string", "right": "string", "distance": "double"})


def rendered(docs: DataFrame, text_col: str) -> DataFrame:
    return rows_of(docs, [text_col], lambda t: [(markdown.rendered(t),)], {"html": "string"})


def reader_violations(readers: DataFrame, html_col: str = "html") -> DataFrame:
    """Rendered readers that are empty, unsafe, or out of balance."""
    h = F.col(html_col)
    rules: dict[str, Column] = {
        "empty": F.trim(h) == "", "unsafe tag": h.rlike(r"(?i)<\s*(script|iframe|object|embed|form)\b"), "unsafe attribute": h.rlike(r"(?i)\son[a-z]+\s*=|href=\"\s*(javascript|data):"),
        "links out of balance": F.regexp_count(h, F.lit("<a ")) != F.regexp_count(h, F.lit("</a>")),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return readers.select("id", F.explode(found).alias("violation"))


_ARTICLE = ["title_zh", "publisher", "source_url", "title_original", "published_at", "category", "priority", "summary"]


def readers(articles: DataFrame) -> DataFrame:
    """(id, has_pdf, html): a whole page of each article (title_zh, publisher, source_url, ..., summary, has_pdf, markdown)."""
    rows = articles.withColumn("_pdf", F.when(F.col("has_pdf"), "x").otherwise(""))

    def make(*values: str) -> list[tuple]:
        article = dict(zip(_ARTICLE, values, strict=False))
        return [(bool(values[-2]), markdown.reader_page(article, markdown.rendered(values[-1]), bool(values[-2])))]

    return rows_of(rows, [*_ARTICLE, "_pdf", "markdown"], make, {"has_pdf": "boolean", "html": "string"})


def page_violations(pages: DataFrame, articles: DataFrame) -> DataFrame:
    """Rules on whole reader pages (id, has_pdf, html) against their articles (id, title_zh, publisher, source_url): id and violation."""
    rows = pages.join(articles.select("id", "title_zh", "publisher", "source_url"), "id", "left")
    h = F.coalesce("html", F.lit(""))
    named = lambda c: F.contains(h, F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")))
    links, refs = F.regexp_count(h, F.lit(f'href="{markdown.PDF}" target="_blank" rel="noreferrer">查看原始报告 PDF ↗</a>')), F.regexp_count(h, F.lit(rf"(?i)href\s*=\s*[\"']{re.escape(markdown.PDF)}[\"']"))
    has = F.coalesce("has_pdf", F.lit(False))
    rules = {
        "empty": ~h.rlike(r'<article class="article-body">[\s\S]+</article>'), "names missing": ~(named("title_zh") & named("publisher") & named("source_url")) | (F.coalesce("title_zh", F.lit("")) == "") | (F.coalesce("source_url", F.lit("")) == ""),
        "no charset": ~h.rlike(r'(?i)<meta charset="utf-8">'), "unsafe": h.rlike(r"(?i)<\s*(script|iframe|object|embed)\b|<[^>]+\son\w+\s*=|javascript:"), "report links missing": has & (links != 2), "report links not expected": (~has & ((links != 0) | (refs != 0))) | (has & (refs != 2)),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return rows.select("id", F.explode(found).alias("violation"))
