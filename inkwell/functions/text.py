"""Column functions on text: tokens, Markdown counts, numbers, links, languages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LATIN = r"[a-z0-9][a-z0-9+._-]*"
#: Han characters; the range before the script leaves most characters of other scripts without a table search.
HAN = r"[\x{2E80}-\x{10FFFF}&&\p{IsHan}]"
URL = r"""https?://[^\s)>\]"']+"""
NUMBER = r"\d+(?:[.,]\d+)*[%‰]?"


def blank(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def clean(col: Column) -> Column:
    """Runs of (Unicode) white space become one space, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(blank(col), r"(?U)\s+", " "), r"^ | $", "")


def bigrams(run: Column) -> Column:
    single = F.array(run)
    return F.when(F.length(run) == 1, single).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2))))


def tokens(col: Column) -> Column:
    """Latin words in lower case, then bigrams of runs of Han characters (a lone one by itself)."""
    text = F.lower(blank(col))
    latin = F.regexp_extract_all(text, F.lit(LATIN), F.lit(0))
    han = F.regexp_extract_all(text, F.lit(f"{HAN}+"), F.lit(0))
    return F.concat(latin, F.flatten(F.transform(han, bigrams)))


def weighted(title: Column, core: Column, evidence: Column, section: Column, content: Column) -> Column:
    """Searchable text: the title counts three times, core view and evidence twice."""
    parts = [title] * 3 + [core] * 2 + [evidence] * 2 + [section, content]
    return F.concat_ws(" ", *[blank(p) for p in parts])


def urls(col: Column) -> Column:
    return F.transform(F.regexp_extract_all(blank(col), F.lit(URL), F.lit(0)), lambda u: F.regexp_replace(u, r"[.,;:!?]+$", ""))


def numbers(col: Column) -> Column:
    return F.regexp_extract_all(blank(col), F.lit(NUMBER), F.lit(0))


def heading_count(col: Column) -> Column:
    return F.regexp_count(blank(col), F.lit(r"(?m)^#{1,6}\s+\S"))


def paragraph_count(col: Column) -> Column:
    """Blocks between blank lines that are not headings."""
    blocks = F.transform(F.split(blank(col), r"\n{2,}"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    return F.size(F.filter(blocks, lambda b: (b != "") & ~b.rlike(r"^#{1,6}\s")))


def characters(col: Column, kind: str) -> Column:
    """How many characters are of a class; ``regexp_count`` would make an array of all of them."""
    return F.length(col) - F.length(F.regexp_replace(col, f"{kind}+", ""))


def han_ratio(col: Column, drop_urls: bool = False) -> Column:
    """Han characters among letters and digits; 0 where there are none."""
    text = F.regexp_replace(blank(col), URL, "") if drop_urls else blank(col)
    return F.coalesce(characters(text, HAN) / F.nullif(characters(text, r"[\p{L}\p{N}]"), F.lit(0)), F.lit(0.0))


def source_language(col: Column) -> Column:
    """zh where Han characters outnumber 0.4 times the Latin letters, else en."""
    return F.when(characters(blank(col), HAN) > 0.4 * characters(blank(col), "[A-Za-z]"), "zh").otherwise("en")


def first_paragraph(col: Column, least: int = 20, most: int = 260) -> Column:
    """The first paragraph of substance, without headings, images and dates."""
    blocks = F.transform(F.split(blank(col), r"\n+"), clean)
    good = F.filter(blocks, lambda b: (F.length(b) >= least) & ~b.rlike(r"^(#|!\[|\d{4}-\d{2}-\d{2})"))
    return F.substring(F.coalesce(F.get(good, F.lit(0)), F.lit("")), 1, most)


def escape_html(col: Column) -> Column:
    out = blank(col)
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def label_distance(a: Column, b: Column) -> Column:
    """Edit distance over the longer length; 0 where both are empty."""
    return F.coalesce(F.levenshtein(blank(a), blank(b)) / F.nullif(F.greatest(F.length(blank(a)), F.length(blank(b))), F.lit(0)), F.lit(0.0))


def missing(required: Column, actual: Column) -> Column:
    """Multiset difference of two arrays: structs of value, required and actual counts where it falls short."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    each = F.transform(F.array_sort(F.array_distinct(required)), lambda v: F.struct(v.alias("value"), count(required, v).alias("required"), count(actual, v).alias("actual")))
    return F.filter(each, lambda x: x.actual < x.required)


def lead_paragraph(col: Column, least: int = 20, most: int = 260) -> Column:
    """The first paragraph of substance in plain words: no headings, images and dated lines, no list marks, links as their labels."""
    blocks = F.transform(F.split(F.regexp_replace(blank(col), r"\r\n?", "\n"), r"\n\s*\n"), lambda b: F.regexp_replace(b, r"^\s+|\s+$", ""))
    kept = F.filter(blocks, lambda b: (b != "") & ~b.rlike(r"^(#{1,6}\s|!\[|\d{4}[ 年-])"))
    words = F.transform(kept, lambda b: F.regexp_replace(F.regexp_replace(F.regexp_replace(b, r"^[-*>\d.\s]+", ""), r"!?\[([^\]]*)\]\([^)]+\)", "$1"), r"[*_`#]", ""))
    long = F.filter(F.transform(words, lambda b: F.regexp_replace(b, r"^\s+|\s+$", "")), lambda b: F.length(b) >= least)
    return F.substring(F.coalesce(F.get(long, F.lit(0)), F.lit("")), 1, most)


def without_citations(col: Column) -> Column:
    """Text without a search index's citation marks: a labelled one leaves its label, the others nothing."""
    labelled = "\ue200cite\ue202[^†\ue201]+†([^\ue201]*?)(?:†[^†\\s\ue201]+)?\ue201"
    out = F.regexp_replace(F.regexp_replace(blank(col), labelled, "$1"), "\ue200cite\ue202[^\ue201]+\ue201", "")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def joined_headings(col: Column) -> Column:
    """Lines that are only heading marks take the next line that isn't empty as their title."""
    return F.regexp_replace(col, r"(?m)^(#{1,6})\n+([^\n]+)", "$1 $2")


def pdf_markdown(title: Column, url: Column, text: Column) -> Column:
    """The text of a report under its title and address: page breaks as rules, no control marks, no more than two empty lines."""
    body = F.regexp_replace(blank(text), r"\f", "\n\n---\n\n")
    for pattern, plain in ((r"[\x08\x0B\x0C]", ""), (r"(?m)[ \t]+$", ""), (r"\n{4,}", "\n\n\n"), (r"^\s+|\s+$", "")):
        body = F.regexp_replace(body, pattern, plain)
    return F.concat(F.lit("# "), title, F.lit("\n\nOfficial report: "), url, F.lit("\n\n"), body, F.lit("\n"))


def clock(milliseconds: Column) -> Column:
    """Minutes and seconds, m:ss."""
    return F.concat(F.floor(milliseconds / 60_000).cast("string"), F.lit(":"), F.lpad(F.floor(F.pmod(milliseconds, F.lit(60_000)) / 1000).cast("string"), 2, "0"))


def word_characters(col: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(blank(col), r"(?U)\s", ""))
