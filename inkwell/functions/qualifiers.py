"""Numbers with their qualifiers: direct ones, cued ones and those a table or caption shares."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import regex

from inkwell.functions import lexicon

_LOCAL = [word for rows in lexicon.QUALIFIERS.values() for _, _, _, local in rows for word in local]


def _any(words: list[str]) -> str:
    return "|".join(regex.escape(w) for w in sorted(words, key=len, reverse=True))


def _english(patterns: list[str]) -> str:
    left, right = lexicon.ENGLISH_BOUNDARY
    return f"{left}(?:{'|'.join(sorted(patterns, key=len, reverse=True))}){right}"


def _category(name: str) -> str:
    """A pattern for all qualifiers of a category; a local word ends where no other Han character follows."""
    symbols, english, local = ([x for row in lexicon.QUALIFIERS[name] for x in row[k]] for k in (1, 2, 3))
    behind = rf"(?=$|[^\p{{Han}}]|(?:{_any(_LOCAL)})|(?:{lexicon.LOCAL_FOLLOWERS}))"
    parts = [_english(english) if english else "", _any(symbols), "|".join(regex.escape(w) + behind for w in sorted(local, key=len, reverse=True))]
    return f"(?:{'|'.join(p for p in parts if p)})"


RATE, SCALE, CURRENCY, UNIT = (_category(name) for name in ("rate", "scale", "currency", "unit"))
QUALIFIER = rf"(?:{RATE}|{CURRENCY}|{UNIT}|{SCALE}(?:\s*(?:{CURRENCY}|{UNIT}))?)"
_FLAGS = regex.IGNORECASE
_BEFORE = regex.compile(rf"{CURRENCY}\Z", _FLAGS)
#: Characters before a number in which a currency is looked for; the longest has 17 and its spaces.
_WIDEST = 200
_BEHIND = regex.compile(rf"\s*{QUALIFIER}", _FLAGS)
_CUES = [regex.compile(cue.replace("{q}", QUALIFIER), _FLAGS) for cue in lexicon.CUES]
_CUE_SIGN = regex.compile(r"[以按]|单位|\bin\s|unit", _FLAGS)
_CAPTION = regex.compile(lexicon.CAPTION, _FLAGS)
_BRACKET = regex.compile(r"[（(]([^（）()\n]{1,60})[）)]")
_ALONE = regex.compile(rf"(?:{lexicon.UNIT_LABEL})?({QUALIFIER})", _FLAGS)
_LABELLED = regex.compile(rf"{lexicon.UNIT_LABEL}({QUALIFIER})", _FLAGS)
_NUMBER = regex.compile(r"\d+(?:[.,]\d+)*")
_DIGIT = regex.compile(r"\d")
_SPACES = regex.compile(r"\s+")
_HAN = regex.compile(r"\p{Han}")
_SENTENCE = regex.compile(r"(?:[^。！？!?；;.]|(?<=\d)\.(?=\d))+")

def _needles(patterns: list[str]) -> list[str]:
    """Letters in lower case that whatever a pattern matches holds: the longest run outside its groups, classes and options."""
    return [max(regex.findall("[a-z]+", regex.sub(r"\(.*?\)\??|\[.*?\]\??|\\s\+|\w\?", "|", p.lower())), key=len) for p in patterns]


#: Characters outside ASCII that equal a letter of it but for case.
_ODD = str.maketrans("\u212a\u017f\u0130\u0131", "ksii")
#: Single definitions in order of category and place, each with what finds its tokens in folded text, and what a text must hold for that.
_DEFINITIONS = [
    (number, place, key, regex.compile("|".join([*([_english([p.lower() if p.isalpha() else p for p in english])] if english else []), *map(regex.escape, (w.lower() for w in symbols))]) or r"(?!)", _FLAGS), [w.lower() for w in local], [*_needles(english), *(w.lower() for w in symbols)])
    for number, rows in enumerate(lexicon.QUALIFIERS.values())
    for place, (key, symbols, english, local) in enumerate(rows)
]


class Anchor(NamedTuple):
    """A number, or ``shared``, with its canonical qualifier ('' if none) and where it stands."""

    line: int
    column: int
    item: str
    number: str
    qualifier: str
    group: int

    @property
    def key(self) -> str:
        return f"{self.number}|{self.qualifier}"


def _local_ends(text: str, end: int) -> bool:
    return end >= len(text) or not _HAN.match(text[end]) or any(text.startswith(w.lower(), end) for w in _LOCAL)


def tokens(text: str) -> list[tuple[int, int, int, str]]:
    """Start, end, category and key of the qualifiers in a text in lower case: leftmost, then longest, none overlapping."""
    found = []
    plain = text.isascii()
    held = text.lower() if plain else text.translate(_ODD).lower()
    for number, place, key, pattern, local, needles in _DEFINITIONS:
        for needle in needles:
            if needle in held:
                found += [(m.start(), -len(m[0]), number, place, key) for m in pattern.finditer(text) if m[0]]
                break
        for word in () if plain else local:
            at = text.find(word)
            while at >= 0:
                if _local_ends(text, at + len(word)):
                    found.append((at, -len(word), number, place, key))
                at = text.find(word, at + 1)
    out, cursor = [], 0
    for at, size, number, _, key in sorted(found):
        if at >= cursor:
            out.append((at, at - size, number, key))
            cursor = at - size
    return out


@lru_cache(maxsize=4096)
def canonical(value: str) -> str:
    """Keys of the qualifiers in a text, by category and place, joined by ``|``."""
    text = _SPACES.sub(" ", unicodedata.normalize("NFKC", value).lower()).strip()
    chosen: dict[str, tuple[int, int]] = {}
    for at, _, number, key in tokens(text):
        chosen.setdefault(key, (number, at))
    return "|".join(sorted(chosen, key=chosen.__getitem__))


def cued(sentence: str, offset: int) -> list[tuple[int, int, str, str]]:
    """Start, end, text and key of the qualifiers that a cue sets apart from their number."""
    if not _CUE_SIGN.search(sentence):
        return []
    out = []
    for cue in _CUES:
        for m in cue.finditer(sentence):
            start = offset + m.start() + m[0].index(m[1])
            if key := canonical(m[1]):
                out.append((start, start + len(m[1]), m[1], key))
    return out


def in_line(text: str, line: int, group: int) -> list[Anchor]:
    """The numbers of a line, where it stands."""
    if not _DIGIT.search(text):
        return []
    found = _known(text) if len(text) <= _SHORT else anchored(text)
    return [Anchor(line, column, item, number, qualifier, group) for column, item, number, qualifier in found]


def anchored(text: str) -> list[tuple[int, str, str, str]]:
    """Column, item, number and qualifier of the numbers of a line, sentence by sentence.

    A currency in front of a number and a qualifier behind it are its own. A cued qualifier that
    is no number's own goes to a number without one that is at most REACH characters away in the
    sentence; nearest pairs first, each qualifier and each number once.
    """
    out = []
    for found in _SENTENCE.finditer(text):
        sentence, base = found[0], found.start()
        numbers: list[tuple[tuple[int, str, str, str], int, int, int, int]] = []
        for m in _NUMBER.finditer(sentence):
            # Parts of their own: what is beyond the number must not bound a qualifier.
            words = sentence[: m.start()].rstrip()
            near = max(0, len(words) - _WIDEST)
            before, behind = _BEFORE.search(words[near:]), _BEHIND.match(sentence[m.end() :])
            start, end = near + before.start() if before else m.start(), m.end() + (behind.end() if behind else 0)
            own = canonical(sentence[start : m.start()] + sentence[m.end() : end])
            item = text[base + start : base + end].strip() or m[0]
            numbers.append(((base + start + 1, item, m[0], own), base + start, base + m.start(), base + m.end(), base + end))
        if not numbers:
            continue
        own = [r for _, start, a, b, end in numbers for r in ((start, a), (b, end)) if r[0] < r[1]]
        free = [q for q in cued(sentence, base) if not any(a < q[1] and q[0] < b for a, b in own)]
        pairs = []
        for k, (start, end, _, _) in enumerate(free):
            for n, (anchor, _, a, b, _) in enumerate(numbers):
                distance = a - end if end <= a else start - b
                if not anchor[3] and 0 <= distance <= lexicon.REACH:
                    pairs.append((distance, start, a, k, n))
        given: dict[int, int] = {}
        for *_, k, n in sorted(pairs):
            if n not in given and k not in given.values():
                given[n] = k
        for n, (anchor, *_) in enumerate(numbers):
            if n in given:
                _, _, words, key = free[given[n]]
                anchor = (anchor[0], f"{anchor[2]} … {words}", anchor[2], key)
            out.append(anchor)
    return out


#: Characters of a line that is looked up, and such lines that a worker remembers: an edit repeats most of its baseline's.
_SHORT = 1000
_known = lru_cache(maxsize=512)(anchored)


def shared(lines: list[tuple[int, str]], group: int, is_divider) -> list[Anchor]:
    """Qualifiers that a table's head or a caption states once for its block."""
    out = []
    digits = [bool(_DIGIT.search(text)) for _, text in lines]
    for i, (line, text) in enumerate(lines):
        head = i + 1 < len(lines) and is_divider(lines[i + 1][1]) and any(digits[i + 2 :])
        caption = _CAPTION.match(text)
        data = caption and (_DIGIT.search(text[caption.end() :]) or any(d for k, d in enumerate(digits) if k != i and not is_divider(lines[k][1])))
        if not head and not data:
            continue
        found = []
        for m in _BRACKET.finditer(text):
            exact = None if _DIGIT.search(m[1]) else _ALONE.fullmatch(m[1].strip())
            if exact:
                found.append((m.start(), m[0], exact[1]))
        found += [(m.start(), m[0], m[1]) for m in _LABELLED.finditer(text)]
        seen: set[str] = set()
        for at, item, value in found:
            if (key := canonical(value)) and key not in seen:
                seen.add(key)
                out.append(Anchor(line, at + 1, item, "shared", key, group))
    return out
