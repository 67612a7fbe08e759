"""Edited Markdown against its baselines: structures, alignment, facts, and the issues of an edit.

A ``Draft`` scans a text once; all checks read its lines and blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple
from urllib.parse import parse_qsl, urlsplit

import regex

from inkwell.functions import lexicon, qualifiers

_LINES = re.compile(r"[^\r\n]*(?:\r\n|\n|$)")
_OPENING = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
_MARKER = re.compile(r"([-+*]|\d+[.)])([ \t]+)")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.DOTALL)
_HEADING = re.compile(r" {0,3}(#{1,6})\s+(.+?)\s*")
_ITEM = re.compile(r"(\s*)([-+*]|\d+[.)])\s+(.+)")
_DIVIDER = re.compile(r":?-{3,}:?")
_INLINE = re.compile(r"""(!?)\[([^\]\n]*)]\(\s*(<[^>\n]+>|[^\s)]+)(?:\s+(?:"[^"]*"|'[^']*'|\([^)]*\)))?\s*\)""")
_USE = re.compile(r"(!?)\[([^\]\n]*)]\[([^\]\n]*)]")
_SHORTCUT = re.compile(r"(?<!\])(!?)\[([^\]\n]+)](?![\[(])")
_DEFINITION = re.compile(r" {0,3}\[([^\]^][^\]]*)]:\s*(<?\S+>?)(?:\s+.*)?")
_NOTED = re.compile(r"\[\^([^\]]+)]\s*:")
_NOTE = re.compile(r"\[\^([^\]]+)]")
_LINK = re.compile(r"""\[([^\]]+)]\((<?[^\s)>]+>?)(?:\s+(["'])(.*?)\3)?\)""")
_URL = re.compile(r"""https?://[^\s)>\]"']+""")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*[%‰]?")
_NOISE = {code: re.compile("|".join(f"(?:{p})" for p in patterns), re.IGNORECASE) for code, patterns in lexicon.NOISE.items()}
_FURNITURE = re.compile("|".join(f"(?:{p.pattern})" for p in _NOISE.values()), re.IGNORECASE)
#: A line as ``str.splitlines`` ends it.
_ROW = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*")
_SPACED, _INDENTED, _LISTED = re.compile(r"\n[ \t]*\r?\n"), re.compile(r" {4}|\t"), re.compile(r"[-+*]\s+")
_INSIDE = re.compile(r"[^\r\n]")
_TARGETS = [(re.compile(label, re.IGNORECASE), set(signs)) for label, signs in lexicon.LINK_TARGETS]


class Line(NamedTuple):
    text: str
    number: int
    code: bool


class Item(NamedTuple):
    """Something a draft has: where, as what it counts, what it says, and how it is shown."""

    line: int
    sign: object
    label: str
    text: str
    column: int = 1


def _columns(blank: str) -> int:
    width = 0
    for c in blank:
        width += 4 - width % 4 if c == "\t" else 1
    return width


def _coded(rows: list[str]) -> list[bool]:
    """Which lines are code: fences with their marks, and lines indented beyond the list around them."""
    out: list[bool] = []
    fence: str | None = None
    lists: list[tuple[int, int]] = []  # indents of open items' markers and contents
    for row in rows:
        if not fence and (row == "\n" or row[0] not in " \t`~-+*\r\n" and not row[0].isdecimal()):
            # Neither code nor list: an empty line, or text that ends the lists around it.
            lists = lists if row == "\n" else []
            out.append(False)
            continue
        text = row.rstrip("\r\n")
        if fence:
            out.append(True)
            mark = text.strip(" \t")
            if len(text) - len(text.lstrip(" ")) <= 3 and mark and set(mark) == {fence[0]} and len(mark) >= len(fence) and not text.startswith("\t"):
                fence = None
            continue
        opening = _OPENING.fullmatch(text)
        if opening and not (opening[1][0] == "`" and "`" in opening[2]):
            fence = opening[1]
            out.append(True)
            continue
        body = text.lstrip(" \t")
        indent = _columns(text[: len(text) - len(body)])
        around = next((content for _, content in reversed(lists) if indent >= content), None)
        marker = _MARKER.match(body)
        if marker and (indent < 4 or around is not None):
            lists = [x for x in lists if x[0] < indent]
            lists.append((indent, indent + len(marker[1]) + _columns(marker[2])))
            out.append(False)
        elif body:
            out.append(indent >= (around + 4 if around is not None else 4))
            if around is None and indent < 4:
                lists = []
        else:
            out.append(False)
    return out


def cells(row: str) -> list[str]:
    inner = row.strip()
    inner = inner[1:] if inner.startswith("|") else inner
    inner = inner[:-1] if inner.endswith("|") else inner
    return [c.strip() for c in re.split(r"(?<!\\)\|", inner)]


def is_divider(row: str) -> bool:
    return "---" in row and all(_DIVIDER.fullmatch(c) for c in cells(row))


def lone_link(line: str) -> str | None:
    """The label of a line that is one link, if its address agrees with what it says."""
    found = _LINK.fullmatch(line)
    target = found[2].strip("<>")
    if found[4] or not re.match("https?://", target, re.IGNORECASE):
        return None
    try:
        at = urlsplit(target)
    except ValueError:
        return None
    signs = {p for p in at.path.lower().split("/") if p} | {x.lower() for pair in parse_qsl(at.query, keep_blank_values=True) for x in pair}
    label = found[1].strip()
    return label if any(pattern.fullmatch(label) and signs & wanted for pattern, wanted in _TARGETS) else None


def noise(block: str) -> str | None:
    """The class of page furniture of a block all of whose lines are of one class."""
    opening = _ROW.match(block.lstrip())[0].rstrip()
    # Most blocks are none by their first line.
    label = lone_link(opening) if _LINK.fullmatch(opening) else opening
    if not label or not _FURNITURE.fullmatch(label):
        return None
    if "`" in block or "~~~" in block or _INDENTED.match(block) or _SPACED.search(block):
        return None
    rows = [x.strip() for x in block.splitlines() if x.strip()]
    if any(_LISTED.match(x) for x in rows):
        return None
    labels = [lone_link(x) if _LINK.fullmatch(x) else x for x in rows]
    return next((code for code, pattern in _NOISE.items() if all(x and pattern.fullmatch(x) for x in labels)), None)


class Draft:
    """A Markdown text, scanned once. ``numbers`` are the lines' numbers where it was cut out of another."""

    def __init__(self, text: str, numbers: list[int] | None = None):
        self.text = text
        raw = [m[0] for m in _LINES.finditer(text) if m[0]]
        coded = _coded(raw)
        hidden = "".join(_INSIDE.sub(" ", x) if code else x for x, code in zip(raw, coded, strict=True))
        if "`" in hidden:
            hidden = _CODE.sub(lambda m: _INSIDE.sub(" ", m[0]), hidden)
        self.numbers = numbers or [*range(1, len(raw) + 1)]
        self.raw = raw
        self.lines: list[Line] = []
        at = 0
        for k, (row, code) in enumerate(zip(raw, coded, strict=True)):
            self.lines.append(Line(hidden[at : at + len(row)].rstrip("\n").rstrip("\r"), self.numbers[k] if k < len(self.numbers) else k + 1, code))
            at += len(row)

    @cached_property
    def blocks(self) -> list[tuple[int, int, bool]]:
        """First line, end line and whether there is code, of each run of lines without an open blank one."""
        out: list[tuple[int, int, bool]] = []
        start = None
        for k, (line, row) in enumerate([*zip(self.lines, self.raw, strict=True), (None, "")]):
            blank = line is None or not line.code and not row.strip(" \t\r\n")
            if blank and start is not None:
                out.append((start, k, any(x.code for x in self.lines[start:k])))
                start = None
            elif not blank and start is None:
                start = k
        return out

    def block(self, start: int, end: int) -> str:
        body = "".join(self.raw[start:end])
        return body.removesuffix("\n").removesuffix("\r") if end < len(self.raw) and body.endswith("\n") else body

    @cached_property
    def _cleaned(self) -> tuple[Draft, list[tuple[int, str, str]]]:
        kept, gone = [], []
        for start, end, code in self.blocks:
            found = None if code else noise(self.block(start, end))
            (gone if found else kept).append((self.lines[start].number, found, self.block(start, end)))
        joint = "\r\n\r\n" if "\r\n" in self.text else "\n\n"
        numbers: list[int] = []
        for k, (line, _, body) in enumerate(kept):
            numbers += [line] * (k > 0) + [line + n for n in range(len(body.split("\n")))]
        return Draft(joint.join(body for *_, body in kept), numbers), [(line, code, body) for line, code, body in gone]

    def cleaned(self) -> tuple[Draft, list[tuple[int, str, str]]]:
        """The draft without furniture, its lines numbered as here, and what went: line, class, block."""
        return self._cleaned

    @cached_property
    def open(self) -> list[Line]:
        return [x for x in self.lines if not x.code]

    def headings(self) -> list[Item]:
        return [Item(x.number, len(m[1]), m[2], x.text) for x in self.open if "#" in x.text and (m := _HEADING.fullmatch(x.text))]

    def items(self) -> list[Item]:
        return [Item(x.number, (len(m[1].replace("\t", "    ")), m[2][0].isdigit()), m[3], x.text) for x in self.open if (m := _ITEM.fullmatch(x.text))]

    def tables(self) -> list[tuple[Item, list[str], int]]:
        """Each table with its headers and its number of rows, the header among them."""
        out, k = [], 0
        while k + 1 < len(self.open):
            head, rule = self.open[k], self.open[k + 1]
            if "|" not in head.text or "|" not in rule.text or not is_divider(rule.text):
                k += 1
                continue
            end = k + 2
            while end < len(self.open) and "|" in self.open[end].text:
                end += 1
            body = "\n".join(x.text for x in self.open[k:end])
            out.append((Item(head.number, "table", body, head.text), cells(head.text), end - k - 1))
            k = end
        return out

    @cached_property
    def references(self) -> tuple[dict[str, tuple[str, Item]], list[tuple[bool, str, Item]]]:
        """Link definitions by id, with their address, and uses of ids: image or not, id, where."""
        found = {k: m for k, x in enumerate(self.open) if "]:" in x.text and (m := _DEFINITION.fullmatch(x.text))}
        known = {}
        for k, m in found.items():
            address = m[2].strip("<>")
            known[m[1].strip().lower()] = (address, Item(self.open[k].number, address, m[1], self.open[k].text.strip(), m.start(1)))
        uses = []
        for k, x in enumerate(self.open):
            if k in found or "[" not in x.text:
                continue
            for m in _USE.finditer(x.text):
                uses.append((bool(m[1]), (m[3] or m[2]).strip().lower(), Item(x.number, None, m[2], m[0], m.start() + 1)))
            for m in _SHORTCUT.finditer(x.text):
                name = m[2].strip().lower()
                if not name.startswith("^") and name in known:
                    uses.append((bool(m[1]), name, Item(x.number, None, m[2], m[0], m.start() + 1)))
        return known, uses

    def links(self, images: bool) -> list[tuple[Item, bool]]:
        """Links or images by address, and whether by reference; a reference without a definition isn't one."""
        out = [(Item(x.number, m[3].strip("<>"), m[2], m[0], m.start() + 1), False) for x in self.open if "](" in x.text for m in _INLINE.finditer(x.text) if bool(m[1]) == images]
        known, uses = self.references
        return out + [(Item(i.line, known[name][0], i.label, i.text, i.column), True) for image, name, i in uses if image == images and name in known]

    def unresolved(self) -> list[tuple[str, Item]]:
        known, uses = self.references
        return [(name, i) for images in (False, True) for image, name, i in uses if image == images and name not in known]

    def footnotes(self) -> tuple[list[Item], list[Item]]:
        """References to footnotes and their definitions."""
        uses, definitions = [], []
        for x in self.open:
            if "[^" not in x.text:
                continue
            if m := _NOTED.match(x.text):
                definitions.append(Item(x.number, m[1], m[1], m[0]))
            else:
                uses += [Item(x.number, m[1], m[1], m[0], m.start() + 1) for m in _NOTE.finditer(x.text)]
        return uses, definitions

    def located(self, pattern: re.Pattern, tail: str = "") -> list[Item]:
        """Matches in the text as it is, code included."""
        out = []
        for k, row in enumerate(self.raw):
            out += [Item(self.lines[k].number, m[0].rstrip(tail), m[0], m[0].rstrip(tail), m.start() + 1) for m in pattern.finditer(row)]
        return out

    @cached_property
    def anchors(self) -> list[qualifiers.Anchor]:
        """Numbers with their qualifiers by block; furniture and blocks of code have none."""
        out, group = [], 0
        for start, end, code in self.blocks:
            lines = [x for x in self.lines[start:end] if not x.code]
            if not lines or (not code and noise(self.block(start, end))):
                continue
            out += qualifiers.shared([(x.number, x.text) for x in lines], group, is_divider)
            for x in lines:
                out += qualifiers.in_line(x.text, x.number, group)
            group += 1
        return out


@lru_cache(maxsize=4096)
def folded(label: str) -> str:
    """A label as it is compared: compatible forms, lower case, no space, punctuation or symbol."""
    return regex.sub(r"[\s\p{P}\p{S}]+", "", unicodedata.normalize("NFKC", label).lower())


def edits(a: str, b: str) -> int:
    """Edit distance, a row of bits at a time."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, last, score = (1 << len(a)) - 1, 0, 1 << (len(a) - 1), len(a)
    full = plus
    for c in b:
        hit = where.get(c, 0)
        diagonal = (((hit & plus) + plus) ^ plus) | hit | minus
        up, down = minus | ~(diagonal | plus), plus & diagonal
        score += bool(up & last) - bool(down & last)
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(diagonal | up)) & full, up & diagonal & full
    return score


@lru_cache(maxsize=4096)
def distance(a: str, b: str) -> float:
    """Edit distance of folded labels over the longer length; 0 where both are empty."""
    a, b = folded(a), folded(b)
    return edits(a, b) / max(len(a), len(b)) if a or b else 0.0


def align(expected: list[Item], actual: list[Item]) -> tuple[list[int], list[tuple[int, int]]]:
    """Indexes of ``expected`` that a cheapest alignment leaves out, and the aligned pairs.

    A gap costs 0.75, a pair of one sign the distance of its labels. Of equal costs a pair is
    taken first, then a gap in ``actual``; read from the end.
    """
    n, m = len(expected), len(actual)
    tail = 0
    # Equal ends pair up in any case.
    while tail < min(n, m) and expected[n - 1 - tail].sign == actual[m - 1 - tail].sign and expected[n - 1 - tail].label == actual[m - 1 - tail].label:
        tail += 1
    pairs = [(n - 1 - k, m - 1 - k) for k in range(tail)]
    n, m = n - tail, m - tail
    gap = lexicon.GAP
    before = [j * gap for j in range(m + 1)]
    steps = ["<" * (m + 1)]
    for i in range(n):
        row, step, mine = [(i + 1) * gap], ["^"], expected[i]
        for j in range(m):
            cost, way = before[j + 1] + gap, "^"
            if row[j] + gap < cost:
                cost, way = row[j] + gap, "<"
            if mine.sign == actual[j].sign and before[j] <= cost and before[j] + (d := distance(mine.label, actual[j].label)) <= cost:
                cost, way = before[j] + d, "\\"
            row.append(cost)
            step.append(way)
        before = row
        steps.append("".join(step))
    missing = []
    while n or m:
        way = steps[n][m] if n else "<"
        if way == "\\":
            n, m = n - 1, m - 1
            pairs.append((n, m))
        elif way == "<":
            m -= 1
        else:
            n -= 1
            missing.append(n)
    return missing[::-1], pairs[::-1]


def lacking(expected: list, actual: list, key: Callable) -> Iterator:
    """What of ``expected`` has no counterpart of its key left in ``actual``, in order."""
    left = Counter(map(key, actual))
    for x in expected:
        if left[key(x)]:
            left[key(x)] -= 1
        else:
            yield x


def beyond(expected: list, actual: list, key: Callable) -> Iterator:
    """The occurrences of a key in ``expected`` after as many as ``actual`` has."""
    have, seen = Counter(map(key, actual)), Counter()
    for x in expected:
        seen[key(x)] += 1
        if seen[key(x)] > have[key(x)]:
            yield x


Issue = tuple[str, int, int, str, str]  # code, line, column, item, detail


def structural(base: Draft, edited: Draft) -> Iterator[Issue]:
    """Headings, items, tables, links, definitions and footnotes that an edit lost."""
    for code, one, other in (("missing_heading", base.headings(), edited.headings()), ("missing_list_item", base.items(), edited.items())):
        for k in align(one, other)[0]:
            yield code, one[k].line, 1, one[k].text, ""
    mine, theirs = base.tables(), edited.tables()
    missing, pairs = align([t[0] for t in mine], [t[0] for t in theirs])
    for k in missing:
        yield "missing_table", mine[k][0].line, 1, mine[k][0].text, ""
    for a, b in pairs:
        (table, headers, rows), (_, new_headers, new_rows) = mine[a], theirs[b]
        if len(new_headers) < len(headers):
            lost = align([Item(0, "", h, h) for h in headers], [Item(0, "", h, h) for h in new_headers])[0]
            yield "missing_table_column", table.line, 1, ", ".join(f'{k + 1} "{headers[k]}"' for k in lost), f"{len(new_headers)} of {len(headers)}"
        if new_rows < rows:
            yield "missing_table_row", table.line, 1, table.text, f"{new_rows} of {rows}"
    for images, inline, reference in ((False, "missing_markdown_link", "missing_reference_link"), (True, "missing_image", "missing_reference_image")):
        for item, by_reference in lacking(base.links(images), edited.links(images), lambda x: x[0].sign):
            yield reference if by_reference else inline, item.line, item.column, item.text, item.sign
    known = base.references[0]
    for name, use in edited.unresolved():
        item = known[name][1] if name in known else use
        yield "missing_link_definition", item.line, item.column, item.text, name
    for kind, one, other in zip(("reference", "definition"), base.footnotes(), edited.footnotes(), strict=True):
        for item in beyond(one, other, lambda x: x.sign):
            yield f"missing_footnote_{kind}", item.line, item.column, item.text, ""


def factual(original: Draft, base: Draft, edited: Draft) -> Iterator[Issue]:
    """Addresses, numbers and qualified facts that an edit lost, against the original and block by block."""
    for item in lacking(original.located(_URL, ".,;:!?"), edited.located(_URL, ".,;:!?"), lambda x: x.text):
        yield "missing_url", item.line, item.column, item.text, ""
    for item in lacking(original.located(_NUMBER), edited.located(_NUMBER), lambda x: x.text.rstrip("%‰")):
        yield "missing_numeric_token", item.line, item.column, item.text, ""
    mine, theirs, first = ([x for x in d.anchors if x.qualifier] for d in (base, edited, original))
    for x in lacking(mine, theirs, lambda x: (x.group, x.key)):
        yield "missing_factual_qualifier", x.line, x.column, x.item, f"before {x.key}"
    extra = [*beyond(first, mine, lambda x: x.key)]
    for x in lacking(extra, theirs, lambda x: x.key):
        yield "missing_factual_qualifier", x.line, x.column, x.item, f"original {x.key}"


def drafted(*texts: str) -> list[Draft]:
    """A draft of each text, one for equal texts."""
    made: dict[str, Draft] = {}
    for text in texts:
        if text not in made:
            made[text] = Draft(text)
    return [made[t] for t in texts]


def issues(original: str, before: str, edited: str) -> list[Issue]:
    """All issues of an edit; furniture of both baselines counts as gone."""
    return lost(*drafted(original, before, edited))


def lost(original: Draft, before: Draft, edited: Draft) -> list[Issue]:
    """``issues`` of drafts."""
    first, base = original.cleaned()[0], before.cleaned()[0]
    return [*factual(first, base, edited), *structural(base, edited)]


def length_ratio(before: str, edited: str) -> float | None:
    """Length of an edit over its baseline's without furniture; null where only the baseline is empty."""
    return lengths(Draft(before), edited)


def lengths(before: Draft, edited: str) -> float | None:
    """``length_ratio`` to a draft."""
    base, mine = len(before.cleaned()[0].text.strip()), len(edited.strip())
    return mine / base if base else None if mine else 1.0
