"""Secret scan with corpus-wide ownership frequency (operator 8).

Pass one finds pattern spans and generic high-entropy candidates in every whole text. Only
salted hashes of their values leave the scan; they are aggregated by distinct repositories
and owners, copies of a text as one repository. A value that many owners carry is a copied example;
one that few owners carry and that looks random is live-looking, and the scan adds a span for
each of its occurrences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.scratch import Scratch

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: A candidate's least entropy in bits a character, and the most owners of a live-looking value. One
#: that leaks does so at its owner and where it was handed to; its repositories may be any number.
ENTROPY, OWNERS = 3.0, 2


def base_values(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end(), m[1]) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return [x[:3] for x in base_values(text)]


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of long tokens that mix letters and digits and look random."""
    out = []
    for m in _TOKEN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= ENTROPY:
            out.append(m.span())
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", max_owners: int = OWNERS) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, base (spans), spans (all), n_live, n_copied, n_repos.

    n_live and n_copied part the base spans by whether few or many owners carry their values; n_repos is the
    largest number of repositories that carry one live value of the row, base or candidate, for how far it has spread.
    A null text counts as empty; a null owner or repository is one owner or repository of its
    own; null ids and repeated rows keep their own row, and copies of a row count once as
    owners; an empty table gives no rows; other columns are not carried. Positions are code
    points. ``token`` spans are those of live-looking candidates: at most ``max_owners``
    distinct owners carry the value anywhere in the corpus, in however many repositories. Copies of
    a text under any ids count as one repository.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "secrets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, extra = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                found = base_values(text)
                base.append([{"s": s, "k": k, "e": e} for s, k, e, _ in found])
                extra.append([{"s": s, "k": 3, "e": e, "v": text[s:e]} for s, e in candidates(text)] + [{"s": s, "k": k, "e": e, "v": v} for s, k, e, v in found])
            spans = pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64())])
            more = pa.struct([("s", pa.int64()), ("k", pa.int32()), ("e", pa.int64()), ("v", pa.string())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(base, pa.list_(spans)), pa.array(extra, pa.list_(more))], ["id", "owner", "repo", "copy", "base", "extra"])

    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{owner_col}`").cast("string").alias("owner"), F.col(f"`{repo_col}`").cast("string").alias("repo"))
    found = slim.withColumn("copy", F.xxhash64("text")).mapInArrow(run, f"id {kind}, owner string, repo string, copy long, base array<struct<s:long,k:int,e:long>>, extra array<struct<s:long,k:int,e:long,v:string>>")
    # Values are replaced by hashes before anything is written.
    found = found.withColumn("extra", F.transform("extra", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), F.xxhash64(F.lit("ownership"), x.v).alias("h"))))
    found = scratch.table(found.withColumn("row", F.monotonically_increasing_id()), "spans")

    each = found.where(F.size("extra") > 0).select("row", "owner", "repo", "copy", F.explode("extra").alias("x")).select("row", "owner", "repo", "copy", "x.*")
    none = F.lit("\0null")
    # From single owners and texts up, so that a value in a third of all rows is reduced on the
    # map side of each shuffle. The least owner and repository stand for all copies of a text.
    carried = each.select("h", "copy", F.coalesce("owner", none).alias("owner"), F.coalesce("repo", none).alias("repo"))
    owners = carried.select("h", "owner").distinct().select("h", F.lit(1).alias("owners"), F.lit(0).alias("repos"))
    repos = carried.groupBy("h", "copy").agg(F.min(F.struct("owner", "repo")).alias("least")).select("h", "least").distinct().select("h", F.lit(0).alias("owners"), F.lit(1).alias("repos"))
    owned = owners.unionByName(repos).groupBy("h").agg(F.sum("owners").alias("owners"), F.sum("repos").alias("repos"))
    live = F.col("owners") <= max_owners
    verdicts = scratch.table(owned.select("h", live.alias("live"), "repos"), "verdicts")
    judged = each.join(verdicts, "h")
    added = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("k") == 3) & F.col("live"), F.struct("s", F.lit(3).alias("k"), "e"))).alias("added"),
        F.count_if((F.col("k") < 3) & F.col("live")).alias("n_live"), F.count_if((F.col("k") < 3) & ~F.col("live")).alias("n_copied"),
        F.max(F.when(F.col("live"), F.col("repos"))).alias("n_repos"),
    )

    def text_of(spans):
        name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), spans.k + 1)
        return F.concat(name, F.lit(":"), spans.s, F.lit(":"), spans.e)

    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    # A candidate inside a base span is the same secret and adds nothing.
    new = F.filter(F.coalesce("added", F.array().cast("array<struct<s:long,k:int,e:long>>")), lambda x: ~F.exists("base", lambda b: (b.s <= x.s) & (b.e >= x.e)))
    full = found.join(added, "row", "left").withColumn("all", F.array_sort(F.concat("base", new)))
    return full.select(
        F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.array_join(F.transform("base", text_of), ",").alias("base"), F.array_join(F.transform("all", text_of), ",").alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.coalesce("n_repos", F.lit(0)).cast("long").alias("n_repos"),
    )
