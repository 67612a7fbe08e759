"""Markdown as blocks: scanning, noise, style, structures, facts, alignment and rendering.

Pure functions on one text; ``inkwell.operators.editorial`` runs them over tables.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

from inkwell.functions import drafts, lexicon, qualifiers

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})\s+(.+?)\s*#*$")
_ITEM = re.compile(r"^(\s*)([-+*]|\d{1,9}[.)])\s+(.*)$")
_QUOTE = re.compile(r"^ {0,3}>\s?(.*)$")
_RULE = re.compile(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$")
_TABLE_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(<?([^\s)>]+)>?(?:\s+\"[^\"]*\")?\)")
_CODE = re.compile(r"`[^`\n]+`")
_INDENTED = re.compile(r"(?m)^(?: {4}|\t)")


@dataclass(frozen=True)
class Block:
    kind: str  # heading, code, table, list, quote, rule, paragraph
    text: str
    line: int  # 1-based
    level: int = 0


@lru_cache(maxsize=64)
def blocks(text: str) -> list[Block]:
    """Blocks in order. Fences run to their end, lists keep their indented lines, tables need their rule."""
    rows = text.replace("\r\n", "\n").split("\n")
    out: list[Block] = []
    i = 0
    while i < len(rows):
        row, start = rows[i], i
        if not row.strip():
            i += 1
            continue
        if fence := _FENCE.match(row):
            i += 1
            while i < len(rows) and not re.match(rf"^ {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}\s*$", rows[i]):
                i += 1
            i += 1
            kind, level = "code", 0
        elif row.startswith(("    ", "\t")):
            while i < len(rows) and (rows[i].startswith(("    ", "\t")) or not rows[i].strip()):
                i += 1
            kind, level = "code", 0
        elif found := _HEADING.match(row):
            i, kind, level = i + 1, "heading", len(found[1])
        elif _RULE.match(row):
            i, kind, level = i + 1, "rule", 0
        elif "|" in row and i + 1 < len(rows) and "-" in rows[i + 1] and _TABLE_RULE.match(rows[i + 1]):
            while i < len(rows) and "|" in rows[i]:
                i += 1
            kind, level = "table", 0
        elif _ITEM.match(row):
            while i < len(rows) and (_ITEM.match(rows[i]) or rows[i].startswith((" ", "\t")) or (not rows[i].strip() and i + 1 < len(rows) and _ITEM.match(rows[i + 1]))):
                i += 1
            kind, level = "list", 0
        elif _QUOTE.match(row):
            while i < len(rows) and _QUOTE.match(rows[i]):
                i += 1
            kind, level = "quote", 0
        else:
            while i < len(rows) and rows[i].strip() and not (i > start and (_FENCE.match(rows[i]) or _HEADING.match(rows[i]) or _ITEM.match(rows[i]) or _QUOTE.match(rows[i]))):
                i += 1
            kind, level = "paragraph", 0
        out.append(Block(kind, "\n".join(rows[start : min(i, len(rows))]).rstrip(), start + 1, level))
    return out


@lru_cache(maxsize=64)
def masked(text: str) -> str:
    """The text with code blanked out, offsets kept."""
    if "`" not in text and "~~~" not in text and not _INDENTED.search(text):
        return text
    rows = text.split("\n")
    for block in blocks(text):
        if block.kind == "code":
            for k in range(block.line - 1, min(block.line - 1 + block.text.count("\n") + 1, len(rows))):
                rows[k] = " " * len(rows[k])
    return _CODE.sub(lambda m: " " * len(m[0]), "\n".join(rows))


def location(text: str, offset: int) -> tuple[int, int]:
    """Line and column, from 1."""
    before = text[:offset]
    return before.count("\n") + 1, offset - (before.rfind("\n") + 1) + 1


#: The class of a block whose every line is furniture of one class.
noise = drafts.noise


def cleaned(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """The text without furniture, and what went: line, class, block."""
    gone = [(b.line, code, b.text) for b in blocks(text) if b.kind == "paragraph" and (code := noise(b.text))]
    rows = text.replace("\r\n", "\n").split("\n")
    drop = {k for line, _, block in gone for k in range(line - 1, line + block.count("\n"))}
    return re.sub(r"\n{3,}", "\n\n", "\n".join(r for k, r in enumerate(rows) if k not in drop)).strip("\n"), gone


_MIXED = re.compile(r"[一-鿿][ \t]*[,;:!?]|[,;:!?][ \t]*[一-鿿]")
_REPEATED = re.compile(r"([，。！？；：,.!?;:])\1+")


def style(text: str, glossary: dict[str, list[str]] | None = None) -> list[tuple[str, int, int, str]]:
    """Risks of Chinese prose: code, line, column, item."""
    plain = masked(text)
    out = []
    for preferred, variants in (glossary or {}).items():
        for variant in variants:
            out += [("prohibited_variant", m.start(), f"{variant} -> {preferred}") for m in re.finditer(re.escape(variant), plain)] if variant else []
    out += [("mixed_punctuation", m.start(), m[0]) for m in _MIXED.finditer(plain)]
    out += [("repeated_punctuation", m.start(), m[0]) for m in _REPEATED.finditer(plain)]
    found = [(code, *location(text, at), item) for code, at, item in out]
    found += [("webpage_noise", b.line, 1, b.text) for b in blocks(text) if b.kind == "paragraph" and noise(b.text)]
    return sorted(found)


def structures(text: str) -> list[tuple[str, str, int]]:
    """Headings, items, tables, links, images, emphasis and footnotes: kind, signature, line."""
    out = []
    for b in blocks(text):
        if b.kind == "heading":
            out.append(("heading", f"h{b.level}", b.line))
        elif b.kind == "list":
            out += [("item", "ordered" if m[2][0].isdigit() else "bullet", b.line + k) for k, row in enumerate(b.text.split("\n")) if (m := _ITEM.match(row))]
        elif b.kind == "table":
            rows = [r for r in b.text.split("\n") if not _TABLE_RULE.match(r)]
            out.append(("table", f"{len(rows)}x{max(len(cells(r)) for r in rows)}", b.line))
        elif b.kind == "code":
            out.append(("code", "block", b.line))
    plain = masked(text)
    for m in _LINK.finditer(plain):
        out.append(("image" if m[1] else "link", m[3], location(text, m.start())[0]))
    for kind, pattern in (("strong", r"\*\*[^*\n]+\*\*"), ("footnote_use", r"\[\^[^\]\s]+\](?!:)"), ("footnote", r"(?m)^\[\^[^\]\s]+\]:")):
        out += [(kind, m[0].rstrip(":") if "footnote" in kind else "**", location(text, m.start())[0]) for m in re.finditer(pattern, plain)]
    return out


def aligned(expected: list[str], actual: list[str], distance) -> list[int]:
    """Indexes of ``expected`` that a cheapest alignment leaves out; a gap costs 0.75."""
    n, m, gap = len(expected), len(actual), 0.75
    cost = [[j * gap for j in range(m + 1)]] + [[(i + 1) * gap] + [0.0] * m for i in range(n)]
    for i in range(n):
        for j in range(m):
            cost[i + 1][j + 1] = min(cost[i][j] + distance(expected[i], actual[j]), cost[i][j + 1] + gap, cost[i + 1][j] + gap)
    out, i, j = [], n, m
    while i:
        if j and cost[i][j] == cost[i - 1][j - 1] + distance(expected[i - 1], actual[j - 1]):
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + gap:
            i -= 1
            out.append(i)
        else:
            j -= 1
    return out[::-1]


_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_DIGIT, _SENTENCE = re.compile(r"\d"), re.compile(r"[^。！？；!?;]+")


def facts(text: str) -> list[tuple[str, str, int, int]]:
    """Numbers with their canonical qualifiers ('' if none): number, qualifier, block, line.

    A qualifier that touches the number counts first; then free ones in the sentence, cued or
    not, go to the nearest number without one, each once, nearest pairs first. This is a wider
    net than ``drafts.Draft.anchors``, whose rules decide what an edit lost.
    """
    out = []
    for group, block in enumerate(b for b in blocks(text) if b.kind != "code" and not (b.kind == "paragraph" and noise(b.text))):
        for k, row in enumerate(masked(block.text).split("\n")):
            for sentence in _SENTENCE.finditer(row) if _DIGIT.search(row) else ():
                found = sentence[0]
                numbers = [(m.start(), m.end(), m[0]) for m in _NUMBER.finditer(found)]
                lower = found.lower()
                signs = [(a, b, key) for a, b, _, key in qualifiers.tokens(lower if len(lower) == len(found) else found)] if numbers else []
                kinds: list[list[str]] = [[] for _ in numbers]
                used = set()
                for n, (a, b, _) in enumerate(numbers):
                    end = b
                    for s, (c, d, key) in enumerate(signs):
                        if s not in used and (found[d:a].strip() == "" and d <= a and a - d <= 1 or c >= end and found[end:c].strip() == "" and c - end <= 1):
                            kinds[n].append(key)
                            used.add(s)
                            end = max(end, d) if c >= end else end
                pairs = sorted((max(a - d, c - b), c, a, s, n) for s, (c, d, _) in enumerate(signs) if s not in used for n, (a, b, _) in enumerate(numbers) if not kinds[n] and 0 <= max(a - d, c - b) <= lexicon.REACH)
                taken = set()
                for _, _, _, s, n in pairs:
                    if s not in used and n not in taken:
                        kinds[n].append(signs[s][2])
                        used.add(s)
                        taken.add(n)
                out += [(value, "+".join(sorted(kinds[n])), group, block.line + k) for n, (_, _, value) in enumerate(numbers)]
    return out


def qualified(text: str) -> Counter:
    """Numbers of a text with their qualifiers, where they have any, and how often."""
    return Counter((v, q) for v, q, _, _ in facts(text) if q)


def drift(before: str, after: str) -> list[tuple[str, str, int]]:
    """What an edit lost: structures and qualified facts, with their count."""
    return lost(before, after, qualified(before), qualified(after))


def lost(before: str, after: str, known: Counter, have: Counter) -> list[tuple[str, str, int]]:
    """``drift`` of texts whose qualified facts are known."""
    out = []
    a, b = Counter((k, s) for k, s, _ in structures(before)), Counter((k, s) for k, s, _ in structures(after))
    out += [(f"missing_{k}", s, n - b[k, s]) for (k, s), n in a.items() if n > b[k, s]]
    out += [("missing_fact", f"{v}|{q}", n - have[v, q]) for (v, q), n in known.items() if n > have[v, q]]
    return sorted(out)


def polished(original: str, before: str, after: str, glossary: dict[str, list[str]] | None = None) -> list[tuple[str, str, int]]:
    """Issues of an edited translation: losses against both baselines, length outside 0.8 to 1.4, style risks."""
    base = cleaned(before)[0]
    known = qualified(base)
    have = known if after == base else qualified(after)
    out = lost(base, after, known, have)
    source = known if original == before else qualified(cleaned(original)[0])
    out += [("missing_source_fact", f"{v}|{q}", n) for (v, q), c in source.items() if c > known[v, q] and (n := c - max(known[v, q], have[v, q])) > 0]
    ratio = len(after) / max(len(base), 1)
    if not 0.8 <= ratio <= 1.4:
        out.append(("length", f"{ratio:.2f}", 1))
    return sorted(out + [(code, item, line) for code, line, _, item in style(after, glossary)])


def cells(row: str) -> list[str]:
    inner = row.strip().removeprefix("|")
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", inner)]


def inline(text: str) -> str:
    """Inline Markdown as HTML; only http(s), mail and relative links stay links."""
    kept: list[str] = []

    def hold(markup: str) -> str:
        kept.append(markup)
        return f"\0{len(kept) - 1}\0"

    def link(m: re.Match) -> str:
        if m[1]:
            return hold(f'<span class="image-alt">图：{html.escape(m[2])}</span>') if m[2].strip() else ""
        safe = re.match(r"(?:https?:|mailto:|[#/.]|[\w-]+(?:[/.#?]|$))", m[3], re.IGNORECASE) and not re.match(r"\s*(?:javascript|data|vbscript):", m[3], re.IGNORECASE)
        if not m[2].strip():
            return ""
        return hold(f'<a href="{html.escape(m[3])}">{inline(m[2])}</a>') if safe else m[2]

    out = _CODE.sub(lambda m: hold(f"<code>{html.escape(m[0][1:-1])}</code>"), text)
    out = html.escape(_LINK.sub(link, out))
    out = re.sub(r"\*\*([^*\n]+)\*\*|__([^_\n]+)__", lambda m: f"<strong>{m[1] or m[2]}</strong>", out)
    out = re.sub(r"(?<![*\w])\*([^*\n]+)\*(?!\*)|(?<![_\w])_([^_\n]+)_(?![_\w])", lambda m: f"<em>{m[1] or m[2]}</em>", out)
    while "\0" in out:
        out = re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], out)
    return out


def rendered(text: str | None) -> str:
    """Markdown as HTML: headings, lists, tables, quotes, code and paragraphs."""
    out = []
    for b in blocks(text or ""):
        rows = b.text.split("\n")
        if b.kind == "heading":
            out.append(f"<h{b.level}>{inline(_HEADING.match(rows[0])[2])}</h{b.level}>")
        elif b.kind == "code":
            fenced = bool(_FENCE.match(rows[0]))
            body = rows[1 : -1 if len(rows) > 1 and _FENCE.match(rows[-1]) else None] if fenced else [re.sub(r"^(?: {4}|\t)", "", r) for r in rows]
            out.append("<pre><code>" + html.escape("\n".join(body)) + "</code></pre>")
        elif b.kind == "rule":
            out.append("<hr>")
        elif b.kind == "table":
            head, *body = [cells(r) for r in rows if not _TABLE_RULE.match(r)]
            out.append("<table><thead><tr>" + "".join(f"<th>{inline(c)}</th>" for c in head) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{inline(c)}</td>" for c in r) + "</tr>" for r in body) + "</tbody></table>")
        elif b.kind == "list":
            items = [_ITEM.match(r) for r in rows]
            tag = "ol" if items[0][2][0].isdigit() else "ul"
            texts: list[str] = []
            for row, item in zip(rows, items, strict=True):
                if item:
                    texts.append(item[3])
                elif row.strip():
                    texts[-1] += " " + row.strip()
            out.append(f"<{tag}>" + "".join(f"<li>{inline(t)}</li>" for t in texts) + f"</{tag}>")
        elif b.kind == "quote":
            out.append("<blockquote>" + rendered("\n".join(_QUOTE.match(r)[1] for r in rows)) + "</blockquote>")
        else:
            out.append("<p>" + inline(" ".join(r.strip() for r in rows)) + "</p>")
    return "".join(out)


#: What a reader page says, and the name of the report beside it (fixed values).
PDF = "原始报告.pdf"
KICKER, NOTE, FOOT = "中文全文", "这是本地归档的完整中文译文，排版供阅读使用；如需核对措辞、图表或最新版本，请以官网原文为准。", "Markdown 译文继续作为本地检索与审计的权威内容源。"
META = [("published_at", "发布日期"), ("category", "文章类别"), ("priority", "优先级")]


def reader_page(article: dict[str, str | None], body: str, pdf: bool = False, home: str = "/", css: str = "") -> str:
    """A whole reader page around a rendered body: names, links, what is known of the article, its summary."""
    e = lambda c: html.escape(article.get(c) or "")
    link = lambda to, label: f'<a href="{to}" target="_blank" rel="noreferrer">{label} ↗</a>'
    nav = f'<nav class="reader-nav" aria-label="文章导航"><a href="{html.escape(home)}">← 返回知识库</a>{link(PDF, "查看原始报告 PDF") if pdf else ""}{link(e("source_url"), "查看官网原文")}</nav>'
    facts = "".join(f"<span><b>{label}</b>{e(c)}</span>" for c, label in META if article.get(c))
    parts = [
        f'<!doctype html>\n<html lang="zh-CN">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<meta name="description" content="{e("title_zh")}的完整中文译文">\n<title>{e("title_zh")} · {e("publisher")}</title>\n',
        f"<style>{css}</style>\n" if css else "", f'</head>\n<body>\n<header class="reader-shell">{nav}<p class="reader-kicker">{e("publisher")} · {KICKER}</p><h1>{e("title_zh")}</h1>',
        f'<p class="original-title" lang="en">{e("title_original")}</p>' if article.get("title_original") else "", f'<div class="meta-row">{facts}</div>' if facts else "", f'</header>\n<main class="reader-main"><p class="translation-note">{NOTE}</p>',
        f'<section class="summary" aria-labelledby="summary-title"><h2 id="summary-title">核心导读</h2><p>{e("summary")}</p></section>' if article.get("summary") else "",
        f'<article class="article-body">{body}</article></main>\n<footer class="reader-shell reader-footer">{nav}<p>{FOOT}</p></footer>\n</body>\n</html>\n',
    ]
    return "".join(parts)
