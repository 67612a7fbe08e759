"""Main text of web pages by markup and nearest-URL page differencing (operator 10).

A page is cut into lines (blocks of text) in one pass over its markup. Lines in menus,
headers, footers, sidebars, notices, adverts, forms, comments and the like are left out by
their elements and names. Pages are then put in the order of host and path; each is paired with the
nearer of the two pages around it on the host whose lines differ from its own (runs of copies
count as one page), their lines are aligned by a longest common subsequence, and shared lines
that no article element vouches for are deleted as template.
Articles share quoted lines with each other, and pages of one host repeat few menus literally,
so neither source of evidence gives right results alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from inkwell.scratch import Scratch, parallelism

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strong sub sup time tt u var wbr".split())
_LEFT_OUT = frozenset("nav footer aside form head title script style noscript template iframe svg math object canvas audio video button select option textarea menu dialog noframes noembed xmp".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same group, where its end tag is missing.
_ENDS = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended widget pagination pager toolbar skip search form".split()
)
#: What such names are joined with: a name of these parts only is left out inside an article as well.
_BOXES = frozenset(
    "box container wrapper wrap inner outer list block area section bar slot item items left right top bottom main site page links buttons button posts articles "
    "policy law icons primary secondary unit text label head title body footer header form count thread reply replies "
    "article content post story inline user users reader readers message mobile desktop sticky native".split()
)
#: Names that are words of their own right: they say nothing unless all words of the name do.
_DOUBTFUL = frozenset("search form alert notice notices respond subscription promotion share sharing social related recommended skip widget banner menu".split())
_CERTAIN = _NAMES - _DOUBTFUL
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|noscript|iframe|xmp|noembed|noframes)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_ARTICLE, _MAIN = 2, 1


def _named(attrs: str, inside: bool) -> tuple[bool, bool, int]:
    """From attributes: left out, a header, and whether the element is an article, the main part or neither. ``inside``: of an article or the main part.

    There a word of a class or id isn't enough to leave an element out, and a doubtful one ("search-results",
    "form-factor") is nowhere: all its words must be such names or what they are joined with.
    """
    out, header, container = False, False, 0
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _NAME_PARTS.findall(one)}
                whole = not parts.isdisjoint(_NAMES) and parts <= _NAMES | _BOXES
                out |= whole or (not inside and not parts.isdisjoint(_CERTAIN))
                header |= "header" in parts
        elif name == "role":
            out |= value.lower() in _ROLES
            container = max(container, {"main": _MAIN, "article": _ARTICLE}.get(value.lower(), 0))
        elif name == "itemprop":
            container = _ARTICLE if {"articleBody", "headline"} & set(value.split()) else container
        elif name == "hidden":
            out = True
        elif name == "aria-hidden":
            out |= value.lower() == "true"
        else:
            out |= re.sub(r"\s", "", value.lower()).find("display:none") >= 0
    return out, header, container


def lines(page: str) -> list[tuple[str, int, bool]]:
    """The page's lines in order: text, container (article, main or 0), mostly links."""
    found: list[tuple[str, int, bool]] = []
    parts: list[str] = []
    linked = [0, 0]
    stack: list[tuple[str, int, int, int]] = []  # tag, left out, header, container
    state = [0, 0, 0]  # open elements that leave out, open headers, container
    link = heading = 0

    def flush(level: int) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append((text, level, linked[0] * 2 > linked[1]))
            parts.clear()
            linked[:] = [0, 0]

    def pop(depth: int) -> None:
        nonlocal link, heading
        while len(stack) > depth:
            tag, out, header, level = stack.pop()
            state[0] -= out
            state[1] -= header
            link -= tag == "a"
            heading -= tag in _HEADINGS
            state[2] = level

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not state[0] and (not state[1] or heading):
            text = page[at : m.start()]
            parts.append(text)
            n = len(text.strip())
            linked[1] += n
            linked[0] += n if link else 0
        at = m.end()
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            flush(state[2])
        if m["end"] or m["end2"]:
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] == tag:
                    pop(d)
                    break
                if tag in _INLINE and stack[d][0] not in _INLINE:
                    break
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            ends = _ENDS.get(tag, ("p",))
            for d in range(len(stack) - 1, -1, -1):
                if stack[d][0] in ends or (tag in _ENDS and stack[d][0] == "p"):
                    pop(d)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[d][0] not in _INLINE:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        out, header, container = _named(attrs, state[2] > 0) if attrs.strip("/ \n\t") else (False, False, 0)
        if tag in ("html", "body", "main"):
            out = header = False
        elif tag == "article":
            header = False
            out = bool(re.search(r"comment", attrs, re.IGNORECASE)) and out
        out = out or tag in _LEFT_OUT
        header = header or tag == "header"
        if header and not state[2]:
            out = True
        stack.append((tag, int(out), int(header), state[2]))
        state[0] += out
        state[1] += header
        link += tag == "a"
        heading += tag in _HEADINGS
        if not state[0]:
            state[2] = max(state[2], container, {"article": _ARTICLE, "main": _MAIN}.get(tag, 0))
    if at < len(page) and not state[0] and not state[1]:
        parts.append(page[at:])
    flush(state[2])
    return found


def content(page: str | None) -> tuple[list[str], list[bool]]:
    """Lines of the page's main part, and which of them a neighbour may still show to be template.

    The main part is the main element with all articles, or where there is none the articles, or
    where there are none all that no name leaves out. Articles, and a main element without any, vouch
    for their lines unless these are mostly links; all other lines are open to doubt.
    """
    found = lines(page or "")
    best = max((level for _, level, _ in found), default=0)
    kept = [x for x in found if x[1] or not best]
    return [t for t, _, _ in kept], [not best or level < best or links for _, level, links in kept]


#: Bits of a table of lines by lines that is kept whole; larger ones are halved.
TABLE = 1 << 26


def _steps(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of ``a``: where the longest common subsequence with the start of ``b`` does not grow, as bits (Hyyrö).

    Costs a few additions of numbers of len(b) bits a line, however often lines repeat.
    """
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = still = (1 << len(b)) - 1
    for x in a:
        grows = still & where.get(x, 0)
        still = ((still + grows) | (still - grows)) & full
        yield still


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each start of ``b``."""
    still = (1 << len(b)) - 1
    for still in _steps(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(still.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.r_[0, np.cumsum(1 - bits.astype(np.int64))]


def _aligned(a: list[int], b: list[int], first: int) -> Iterator[int]:
    """Indexes of ``a``, counted from ``first``, in a longest common subsequence with ``b``."""
    if not a or not b:
        return
    if len(a) * len(b) > TABLE and len(a) > 1:  # halves of ``a`` meet where both parts of ``b`` share the most (Hirschberg)
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        yield from _aligned(a[:half], b[:cut], first)
        yield from _aligned(a[half:], b[cut:], first + half)
        return
    table = [*_steps(a, b)]
    i, j = len(a), len(b)
    while i and j:
        if table[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or table[i - 1] >> (j - 1) & 1:
                j -= 1
                yield first + i


def shared(mine: list[int], other: list[int]) -> set[int]:
    """Indexes of ``mine`` in a longest common subsequence with ``other``, in time and space that repeated lines don't add to."""
    lo = 0
    while lo < min(len(mine), len(other)) and mine[lo] == other[lo]:
        lo += 1
    hi = 0
    while hi < min(len(mine), len(other)) - lo and mine[-1 - hi] == other[-1 - hi]:
        hi += 1
    return {*range(lo), *range(len(mine) - hi, len(mine)), *_aligned(mine[lo : len(mine) - hi], other[lo : len(other) - hi], lo)}


def near(a: str, b: str) -> int:
    """Length of the common start of two paths."""
    return next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


def template(page: dict, neighbours: list[dict]) -> list[int]:
    """Indexes of a page's lines shared with the nearest page of its host that is no copy of it."""
    others = [x for x in neighbours if x["host"] == page["host"] and x["all"] != page["all"]]
    best = max(others, key=lambda x: near(page["path"], x["path"]), default=None)
    return sorted(shared(page["all"], best["all"])) if best else []


def same(a: dict, b: dict) -> bool:
    """Whether two pages are of one run: copies of each other on a host."""
    return a["host"] == b["host"] and a["all"] == b["all"]


def sides(run: dict, before: dict | None, after: dict | None) -> list[tuple[str, list[int]] | None]:
    """Path and shared lines of the pages around a run; None where its host has none. All pages of the run share them."""
    return [(x["path"], sorted(shared(run["all"], x["all"]))) if x and x["host"] == run["host"] else None for x in (before, after)]


def nearer(path: str, around: list[tuple[str, list[int]] | None]) -> list[int]:
    """The shared lines on the side that is nearer to ``path``, the side before it where they are equally near."""
    return max((x for x in around if x), key=lambda x: near(path, x[0]), default=("", []))[1]


def outer(parts: list[dict]) -> Iterator[tuple[int, int, list[tuple[str, list[int]] | None]]]:
    """Partition, 0 or 1 and ``sides`` of each partition's first and last run, which go on in other partitions.

    A part has its number, its number of runs, which of the two runs has pages to decide, and four
    pages: the first of its first and second run, and the last of its last but one and last run.
    """
    parts = sorted(parts, key=lambda x: x["part"])
    before: list[dict | None] = [None] * len(parts)
    after: list[dict | None] = [None] * len(parts)
    for i in range(1, len(parts)):
        x = parts[i - 1]
        before[i] = x["last"] if not same(x["last"], parts[i]["first"]) else x["penult"] if x["runs"] > 1 else before[i - 1]
    for i in range(len(parts) - 2, -1, -1):
        x = parts[i + 1]
        after[i] = x["first"] if not same(x["first"], parts[i]["last"]) else x["second"] if x["runs"] > 1 else after[i + 1]
    for x, b, a in zip(parts, before, after, strict=True):
        if x["opens"][0]:
            yield x["part"], 0, sides(x["first"], b, x["second"] if x["runs"] > 1 else a)
        if x["opens"][1]:
            yield x["part"], 1, sides(x["last"], x["penult"], a)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, url and text (its lines joined by one space).

    White space in a line becomes one space, character references are decoded, and nothing
    is cut off. A null or empty page has the empty text; a null URL has a host of its own;
    null and repeated ids and repeated pages are kept as they are (a copy of a page is no
    evidence against it); other columns are not carried; an empty table gives no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "pages")
    id_type = pages.schema[id_col].dataType
    kind = id_type.simpleString()
    url = F.lower(F.coalesce(F.col("url"), F.lit("")))
    slim = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    slim = slim.withColumn("h", F.xxhash64("url", "html")).withColumn("host", F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)", 1))
    slim = slim.withColumn("path", F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"#.*$", ""))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts, kept, every, undecided = [], [], [], []
                for page in part.column(2).to_pylist():
                    found, doubtful = content(page)
                    every.append([xxhash.xxh64_intdigest(t) - (1 << 63) for t in found])
                    is_open = any(doubtful)
                    undecided.append(is_open)
                    texts.append(None if is_open else " ".join(found))
                    kept.append([{"t": t, "d": d} for t, d in zip(found, doubtful, strict=True)] if is_open else None)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(3), part.column(4), part.column(5), pa.array(texts, pa.string()),
                    pa.array(kept, pa.list_(pa.struct([("t", pa.string()), ("d", pa.bool_())]))), pa.array(every, pa.list_(pa.int64())), pa.array(undecided, pa.bool_()),
                ], ["page_id", "url", "h", "host", "path", "text", "kept", "all", "open"])

    parsed = scratch.table(slim.select("page_id", "url", "html", "h", "host", "path").mapInArrow(parse, f"page_id {kind}, url string, h long, host string, path string, text string, kept array<struct<t:string,d:boolean>>, all array<long>, open boolean"), "parsed")

    # Neighbours: a range partitioning keeps a hot host in order over many tasks. A run inside a
    # partition is decided there; of the first and the last run, which may go on over any number of
    # partitions, four pages a partition meet in one task, and each page is then decided by theirs.
    order = ["host", "path", "page_id", "h"]
    once = parsed.select(*order, "all", "open").dropDuplicates(order)  # repeated rows share one answer
    ordered = once.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    page_type = to_arrow_type(id_type)
    body = pa.struct([("host", pa.string()), ("path", pa.string()), ("all", pa.list_(pa.int64()))])
    ends = ("first", "second", "penult", "last")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run = last = before = None
        runs, opens = 0, [False, False]
        at: dict[str, dict | None] = dict.fromkeys(ends)
        waiting: list[tuple] = []  # pages of the run that are to be decided: id, hash, path
        done: list[tuple] = []
        for row in (r for batch in batches for r in batch.to_pylist()):
            if run is None or not same(run, row):
                if runs == 1:
                    opens[0] = bool(waiting)
                    done += [(i, h, None, path, 0) for i, h, path in waiting]
                elif waiting:
                    around = sides(run, before, row)
                    done += [(i, h, nearer(path, around), None, None) for i, h, path in waiting]
                run, before, waiting, runs = row, last, [], runs + 1
                if runs <= 2:
                    at[ends[runs - 1]] = row
                if len(done) >= 1000:
                    yield rows(done, part, None)
                    done = []
            last = row
            if row["open"]:
                waiting.append((row["page_id"], row["h"], row["path"]))
        if runs:
            side = int(runs > 1)
            opens[side] = bool(waiting)
            done += [(i, h, None, path, side) for i, h, path in waiting]
            at |= {"penult": before, "last": last}
            yield rows(done, part, {"runs": runs, "opens": opens} | {k: x and {n: x[n] for n in ("host", "path", "all")} for k, x in at.items()})

    def rows(done: list, part: int, end: dict | None) -> pa.RecordBatch:
        columns = [*map(list, zip(*done, strict=True))] if done else [[], [], [], [], []]
        kinds = [page_type, pa.int64(), pa.list_(pa.int64()), pa.string(), pa.int32()]
        extra = [None] if end else []
        return pa.RecordBatch.from_arrays([
            *(pa.array(c + extra, t) for c, t in zip(columns, kinds, strict=True)), pa.array([part] * (len(done) + len(extra)), pa.int64()),
            pa.array([None] * len(done) + [end] * len(extra), pa.struct([("runs", pa.int64()), ("opens", pa.list_(pa.bool_())), *((k, body) for k in ends)])),
        ], ["page_id", "h", "shared", "path", "side", "part", "ends"])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [*outer([r["ends"] | {"part": r["part"]} for batch in batches for r in batch.to_pylist()])]
        around = pa.list_(pa.struct([("path", pa.string()), ("shared", pa.list_(pa.int64()))]))
        yield pa.RecordBatch.from_arrays([
            pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int32()),
            pa.array([[y and {"path": y[0], "shared": y[1]} for y in x[2]] for x in found], around),
        ], ["part", "side", "around"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                found = [nearer(p, [y and (y["path"], y["shared"]) for y in x]) for p, x in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int64()))], ["page_id", "h", "shared"])

    slim_body = "struct<host:string,path:string,all:array<long>>"
    paired = scratch.table(ordered.mapInArrow(pair, f"page_id {kind}, h long, shared array<long>, path string, side int, part long, ends struct<runs:long,opens:array<boolean>,{','.join(f'{k}:{slim_body}' for k in ends)}>"), "paired")
    outside = paired.where("ends is not null").select("part", "ends").coalesce(1).mapInArrow(join_ends, "part long, side int, around array<struct<path:string,shared:array<long>>>")
    left = paired.where("side is not null").select("page_id", "h", "path", "part", "side")
    # Two rows a partition, each with the lines of one page at most.
    left = left.join(F.broadcast(outside), ["part", "side"]).select("page_id", "h", "path", "around")
    verdicts = paired.where("shared is not null").select("page_id", "h", "shared").unionByName(left.mapInArrow(decide, f"page_id {kind}, h long, shared array<long>"))

    decided = parsed.where("not open").select("page_id", "url", "text")
    doubtful = parsed.where("open").select("page_id", "url", "h", "kept")
    mine = F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("h") == F.col("v_h"))
    resolved = doubtful.join(verdicts.select(F.col("page_id").alias("v_id"), F.col("h").alias("v_h"), "shared"), mine, "left")
    # Sets of line numbers: linear in the lines, where a search of ``shared`` for each line is not.
    every = F.sequence(F.lit(0), F.size("kept") - 1)
    doubt = F.filter(every, lambda i: F.get("kept", i).d)
    gone = F.array_intersect(doubt, F.coalesce(F.col("shared").cast("array<int>"), F.array().cast("array<int>")))
    stays = F.transform(F.array_except(every, gone), lambda i: F.get("kept", i).t)
    resolved = resolved.select("page_id", "url", F.array_join(stays, " ").alias("text"))
    return decided.unionByName(resolved).withColumnsRenamed({"page_id": id_col, "url": url_col})
