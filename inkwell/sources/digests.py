"""HTML digests: cards of many layouts into one record model; page extraction to Markdown.

A layout is data: selectors by field. The parser builds a small tree, so that a card's parts
are found by class, attribute or heading whatever their order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.sources import density

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@lru_cache(maxsize=1024)
def _selector(simple: str) -> tuple[str, frozenset[str], list[tuple[str, str]]]:
    """Tag, classes, and attributes with their values, of a selector without blanks."""
    m = re.fullmatch(r"([\w-]*)((?:\.[\w-]+)*)((?:\[[^\]]+\])*)", re.sub(r"#([\w-]+)", r"[id=\1]", simple))
    return m[1], frozenset(m[2].split(".")[1:]), [tuple((a.split("=", 1) + [""])[:2]) for a in re.findall(r"\[([^\]]+)\]", m[3])]


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    parent: Node | None = None
    children: list = field(default_factory=list)

    def text(self, without: str = "") -> str:
        skip = set(without.split(","))
        parts = [c if isinstance(c, str) else "" if c.tag in skip or skip & set(c.attrs.get("class", "").split()) else c.text(without) for c in self.children]
        return re.sub(r"\s+", " ", " ".join(parts).replace(" ", " ")).strip()

    def all(self) -> Iterator[Node]:
        open_ = [c for c in reversed(self.children) if isinstance(c, Node)]
        while open_:
            node = open_.pop()
            yield node
            open_ += [c for c in reversed(node.children) if isinstance(c, Node)]

    def matches(self, simple: str) -> bool:
        tag, classes, attrs = _selector(simple)
        if tag and tag != self.tag or classes and not classes <= set(self.attrs.get("class", "").split()):
            return False
        return all(name in self.attrs and (not value or self.attrs[name] == value.strip('"')) for name, value in attrs)

    def find(self, selector: str) -> list[Node]:
        """Nodes by ``a b, c``: descendants, in order; alternatives by comma."""
        out: list[Node] = []
        for choice in selector.split(","):
            found = [self]
            for simple in choice.split():
                found = list(dict.fromkeys(id(n) and n for f in found for n in f.all() if n.matches(simple)))
            out += found
        return out

    def __hash__(self) -> int:
        return id(self)


#: Elements whose start ends an open paragraph, and for elements that may lack an end tag those that their start ends and those that keep it from doing so.
_ENDS_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ENDS = {"p": ({"p"}, {"table", "td", "th", "caption", "button", "object", "template"}), "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {})

    def _end(self, ended: set[str], bounds: set[str]) -> None:
        node = self.at
        while node.parent and node.tag not in ended and node.tag not in bounds:
            node = node.parent
        if node.tag in ended:
            self.at = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end(*_ENDS["p"])
        if tag in _ENDS and tag != "p":
            self._end(*_ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node and node.tag != tag:
            node = node.parent
        if node and node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    return builder.root


#: Layouts: the card, and for each field the places to look in turn. ``@x`` is an attribute of
#: the card, ``heading:pattern`` the first paragraph of the section below such a heading.
LAYOUTS = {
    "outline": {
        "card": "article.article-card", "id": ["@id"], "title_original": ["h3"], "title_zh": [".translated-title"], "published_at": [".date"], "score": [".score"], "priority": ["@data-priority", ".priority"],
        "category": ["@data-categories"], "confidence": [".confidence"], "core_zh": ["heading:核心观点"], "evidence": ["heading:关键证据"], "impact": ["heading:^影响面$"],
    },
    "bilingual": {
        "card": "article.analysis-card", "id": ["@data-radar-id", "@id"], "title_original": [".original-title", "h3 [data-lang-content=en]"], "title_zh": ["h3 [data-lang-content=zh]", "h3"], "published_at": [".eyebrow"],
        "score": ["@data-score"], "priority": ["@data-priority"], "category": ["@data-category"], "confidence": [".chips", ".confidence"], "core_zh": [".take [data-lang-content=zh]"], "evidence": ["heading:关键证据|Key evidence"], "impact": ["heading:影响范围|Impact"],
    },
    "scoreline": {
        "card": "article.article-card", "id": ["@data-radar-id", "@id"], "title_original": [".original-title", ".source-title"], "title_zh": ["h3 [data-lang-content=zh]", "h3"], "published_at": [".eyebrow", "footer span"],
        "score": ["@data-score"], "priority": ["@data-priority"], "category": ["@data-category"], "confidence": [".scoreline", "p.confidence", ".confidence"], "core_zh": [".core [data-lang-content=zh]", "heading:核心观点"], "evidence": ["heading:关键证据|Key evidence", ".evidence"], "impact": ["heading:影响范围|Impact|^影响$"],
    },
}


def _value(card: Node, place: str) -> str:
    if place.startswith("@"):
        return card.attrs.get(place[1:], "").strip()
    if place.startswith("heading:"):
        for h in card.find("h4"):
            if re.search(place[8:], h.text()) and h.parent:
                return next((p.text("small") for p in h.parent.find("p, li")), h.parent.text("h4"))
        return ""
    return next((n.text() for n in card.find(place)), "")


def cards(html: str, layout: str) -> list[dict[str, str | None]]:
    """One record a card; the last https link is its source."""
    rules = LAYOUTS[layout]
    out = []
    for card in tree(html).find(rules["card"]):
        row = {name: next((v for p in places if (v := _value(card, p))), None) for name, places in rules.items() if name != "card"}
        links = [a.attrs.get("href", "") for a in card.find("a")]
        row["source_url"] = next((u for u in reversed(links) if u.startswith("https://")), None)
        if row["published_at"]:
            row["published_at"] = (re.search(r"\d{4}-\d{2}-\d{2}", row["published_at"]) or [row["published_at"]])[0]
        number = re.search(r"\d+(?:\.\d+)?", row["score"] or "")
        row["score"] = number[0] if number else None
        out.append(row)
    return out


FIELDS = [*(k for k in LAYOUTS["outline"] if k != "card"), "source_url"]


def scan(digests: DataFrame, expected: dict[str, int] | None = None) -> DataFrame:
    """Records of (digest, layout, html); ``expected`` counts by digest fail the scan where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, layout, page in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = cards(page, layout)
                if expected and digest in expected and len(rows) != expected[digest]:
                    raise ValueError(f"{digest}: expected {expected[digest]} cards, found {len(rows)}")
                yield pa.RecordBatch.from_arrays([pa.array([digest] * len(rows), pa.string()), *(pa.array([r[f] for r in rows], pa.string()) for f in FIELDS)], ["digest", *FIELDS])

    return digests.select("digest", "layout", "html").mapInArrow(run, "digest string, " + ", ".join(f"{f} string" for f in FIELDS))


_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th"}
_NOISE = {"nav", "footer", "header", "aside", "form", "script", "style", "noscript", "button", "svg"}


def article(html: str, url: str, least: int = 300) -> dict:
    """Main content as Markdown with absolute links, its counts, and whether it is thin."""
    root = tree(html)
    for choice in ("main article", "article", "main", "body"):
        found = next((n for n in root.find(choice) if len(n.text(",".join(_NOISE))) >= least), None)
        if found:
            break
    found = found or root
    title = next((t for s in ("h1", "meta[property=og:title]", "title") for n in root.find(s) if (t := n.attrs.get("content") or n.text())), None)
    date = next((n.attrs.get("datetime") or n.attrs.get("content") for s in ("meta[property=article:published_time]", "time") for n in root.find(s)), None)
    lines: list[str] = []

    def inline(node: Node) -> str:
        out = []
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag == "a" and c.attrs.get("href"):
                out.append(f"[{c.text()}]({urljoin(url or '', c.attrs['href'])})")
            elif c.tag not in _NOISE and not ({"ad", "ads"} & set(c.attrs.get("class", "").split())) and c.tag not in _BLOCKS:
                out.append(inline(c) if c.tag != "br" else " ")
        return re.sub(r"\s+", " ", "".join(out)).strip()

    def walk(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str) or c.tag in _NOISE or {"ad", "ads"} & set(c.attrs.get("class", "").split()):
                continue
            if c.tag in _BLOCKS and (text := inline(c)):
                lead = "#" * int(c.tag[1]) + " " if c.tag[0] == "h" and c.tag[1:].isdigit() else "- " if c.tag == "li" else "> " if c.tag == "blockquote" else ""
                lines.append(lead + text)
            walk(c)

    walk(found)
    body = "\n\n".join(lines)
    headings = sum(x.startswith("#") for x in lines)
    visible = len(re.sub(r"\s+", " ", " ".join(lines)))
    return {"status": "extracted" if visible >= least else "thin", "title": title, "published_at": date, "markdown": body, "heading_count": headings, "paragraph_count": len(lines) - headings, "character_count": visible}


def articles(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    kind = pages.schema[id_col].dataType.simpleString()
    fields = {"status": pa.string(), "title": pa.string(), "published_at": pa.string(), "markdown": pa.string(), "heading_count": pa.int32(), "paragraph_count": pa.int32(), "character_count": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [article(h or "", u or "") for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], t) for k, t in fields.items())], [id_col, *fields])

    ddl = f"`{id_col}` {kind}, status string, title string, published_at string, markdown string, heading_count int, paragraph_count int, character_count int"
    return pages.select(F.col(id_col), "url", "html").mapInArrow(run, ddl)


#: Card classes of the generic scan, and its score pattern (fixed values).
CARDS = {"article-card", "analysis-card"}
SCORE = re.compile(r"\b(100|[1-9]?\d)(?:/100|/10)?\b")
GENERIC = {
    "id": "string", "source_url": "string", "title_original": "string", "title_zh": "string", "published_at": "string", "category": "string", "priority": "string", "score": "int",
    "confidence": "string", "core_view": "string", "evidence": "string", "locator": "string", "implication": "string", "element_id": "string",
}


def generic_cards(html: str) -> list[dict]:
    """Records of any digest's cards: text is told apart by the tags and classes around it, whatever the layout."""
    out = []
    for card in tree(html).find("article"):
        if not CARDS & set(card.attrs.get("class", "").split()):
            continue
        around: set[str] = set()
        above = card.parent
        while above is not None:
            around |= {above.tag, *above.attrs.get("class", "").split()}
            above = above.parent
        said: dict[str, list[str]] = {}

        def walk(node: Node, names: set[str], said=said) -> None:
            names = names | {node.tag, *node.attrs.get("class", "").split()}
            if node.tag == "time" and node.attrs.get("datetime"):
                said.setdefault("date", []).append(node.attrs["datetime"])
            for child in node.children:
                if isinstance(child, Node):
                    walk(child, names)
                elif words := " ".join(child.split()):
                    for name in names:
                        said.setdefault(name, []).append(words)

        walk(card, around)
        of = lambda *names, said=said: next((x for n in names if (x := " ".join(" ".join(said.get(n, [])).split()))), None)
        heading, original, translated = of("h3", "h2"), of("original-title"), of("translated-title")
        a = card.attrs
        score = a.get("data-score")
        if score is None:
            found = SCORE.search(of("score", "score-orbit") or "")
            score = found[1] if found else None
        links = [n.attrs["href"] for n in card.all() if n.tag == "a" and n.attrs.get("href", "").startswith("https://")]
        evidence = of("evidence", "key-evidence")
        out.append({
            "id": a.get("data-radar-id") or a.get("id") or None, "source_url": links[-1] if links else None, "title_original": heading if translated or not original else original, "title_zh": translated or (heading if original else None),
            "published_at": of("date"), "category": a.get("data-category") or a.get("data-categories"), "priority": (a.get("data-priority") or "").lower() or None, "score": int(score) if score and score.isdigit() else None,
            "confidence": of("confidence"), "core_view": of("core", "take"), "evidence": evidence, "locator": of("locator") if evidence else None, "implication": of("implication"), "element_id": a.get("id"),
        })
    return out


def generic(digests: DataFrame) -> DataFrame:
    """Records of (digest, html) by ``generic_cards``; null pages have none."""
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                found = [(d, r) for d, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in generic_cards(page or "")]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.string()), *(pa.array([r[f] for _, r in found], types[t]) for f, t in GENERIC.items())], ["digest", *GENERIC])

    return digests.select("digest", "html").mapInArrow(run, "digest string, " + ", ".join(f"{f} {t}" for f, t in GENERIC.items()))


def write_lines(records: DataFrame, path: str) -> None:
    """Records as lines of JSON."""
    records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


#: Where each publisher's articles are, in turn; what is no part of them; least visible characters (fixed values).
SELECTORS = {
    "BCG": ["main article", "[data-component=article-body]", "main"],
    "Anthropic": ["main article", "#main-content", "main"],
    "McKinsey": ["main article", ".article-body", "[data-module=ArticleBody]", "main"],
    "MIT": ["main article", "main[role=main]", "main"],
    "Bain": ["main article", "main[role=main]", "main"],
}
OTHERS = ["main article", "article", "main"]
LEFT_OUT = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form"}
LEFT_OUT_CLASSES, LEFT_OUT_IDS = ["cookie", "newsletter", "related", "recommend", "social-share"], ["cookie"]
VISIBLE = 300


def left_out(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in LEFT_OUT or a.get("aria-hidden") == "true"
        or any(x in a.get("class", "").lower() for x in LEFT_OUT_CLASSES) or any(x in a.get("id", "").lower() for x in LEFT_OUT_IDS)
    )


def _cleaned(node: Node, url: str) -> Node:
    """A copy without what is left out, its links and images with absolute addresses."""
    copy = Node(node.tag, dict(node.attrs))
    for name in ("href", "src"):
        if name in copy.attrs and copy.tag in ("a", "img"):
            try:
                copy.attrs[name] = urljoin(url, copy.attrs[name])
            except ValueError:
                del copy.attrs[name]
    for child in node.children:
        if isinstance(child, str):
            copy.children.append(child)
        elif not left_out(child):
            inner = _cleaned(child, url)
            inner.parent = copy
            copy.children.append(inner)
    return copy


def _visible(node: Node) -> str:
    def texts(n: Node) -> Iterator[str]:
        for c in n.children:
            if isinstance(c, str):
                yield c
            else:
                yield from texts(c)

    return re.sub(r"\s+", " ", "".join(texts(node))).strip()


def _markdown(node: Node) -> str:
    """Blocks of a cleaned element as Markdown."""
    out: list[str] = []

    def inline(n: Node) -> str:
        parts = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "a" and c.attrs.get("href"):
                parts.append(f"[{_visible(c)}]({c.attrs['href']})")
            elif c.tag == "img" and c.attrs.get("src"):
                parts.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
            elif c.tag in ("strong", "b", "em", "i", "code") and (text := _visible(c)):
                mark = {"strong": "**", "b": "**", "code": "`"}.get(c.tag, "_")
                parts.append(f"{mark}{text}{mark}")
            elif c.tag not in _BLOCKS:
                parts.append(inline(c) if c.tag != "br" else " ")
        return re.sub(r"\s+", " ", "".join(parts)).strip()

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, Node):
                if c.tag in _BLOCKS and (text := inline(c)):
                    lead = "#" * int(c.tag[1]) + " " if re.fullmatch(r"h[1-6]", c.tag) else {"li": "- ", "blockquote": "> "}.get(c.tag, "")
                    out.append(lead + text)
                walk(c)

    walk(node)
    return "\n\n".join(out)


def extracted(html: str, url: str, publisher: str) -> dict:
    """An article by its publisher's places, with its counts and data about it.

    The first place whose visible text has 300 characters or more is taken. Where none has, the elements with
    most points of density are; a page without any paragraph is thin and empty, unless its body has much text.
    """
    root = tree(html)
    meta = lambda key, name: next((v for n in root.find("meta") if n.attrs.get(key) == name and (v := n.attrs.get("content", "").strip())), None)
    first = lambda selector: next((v for n in root.find(selector)[:1] if (v := re.sub(r"\s+", " ", _visible(n)))), None)
    chosen, method = None, "none"
    for selector in SELECTORS.get(publisher, OTHERS):
        place = next(iter(root.find(selector)), None)
        cleaned = place and _cleaned(place, url)
        if cleaned and len(_visible(cleaned)) >= VISIBLE:
            chosen, method = cleaned, f"selector:{selector}"
            break
    if chosen is None and (parts := density.article(_cleaned(root, url))):
        chosen, method = Node("main", {}, None, parts), "readability"
    about = {
        "title": first("h1") or meta("property", "og:title") or first("title"), "byline": meta("name", "author") or first("[rel=author]"),
        "published_at": meta("property", "article:published_time") or next((n.attrs["datetime"] for n in root.find("time") if n.attrs.get("datetime")), None),
    }
    if chosen is None:
        return {"status": "thin", "method": method, **about, "markdown": "", "heading_count": 0, "paragraph_count": 0, "character_count": 0}
    nodes, size = [*chosen.all()], len(_visible(chosen))
    headings = sum(bool(re.fullmatch(r"h[1-6]", n.tag)) for n in nodes)
    return {"status": "extracted" if size >= VISIBLE else "thin", "method": method, **about, "markdown": _markdown(chosen), "heading_count": headings, "paragraph_count": sum(n.tag == "p" for n in nodes), "character_count": size}


def extractions(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``extracted`` of (id, url, html, publisher); null pages are thin."""
    kind = pages.schema[id_col].dataType.simpleString()
    fields = {"status": pa.string(), "method": pa.string(), "title": pa.string(), "byline": pa.string(), "published_at": pa.string(), "markdown": pa.string(), "heading_count": pa.int32(), "paragraph_count": pa.int32(), "character_count": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                found = [extracted(h or "", u or "", p or "") for u, h, p in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([x[k] for x in found], t) for k, t in fields.items())], [id_col, *fields])

    ddl = f"`{id_col}` {kind}, " + ", ".join(f"{k} {'string' if t == pa.string() else 'int'}" for k, t in fields.items())
    return pages.select(F.col(id_col), "url", "html", "publisher").mapInArrow(run, ddl)


def webinar(title: str, url: str, html: str, video: str, video_id: str, duration: int, transcript: str | None) -> str:
    """A recorded talk's page as Markdown: what the page says of it, the recording, linked resources, and its captions if there are any."""
    root = tree(html)
    said = lambda selector: next((_visible(n) for n in root.find(selector)), "")
    links: dict[str, str] = {}
    for n in root.find("[itemprop=articleBody] a"):
        label, target = _visible(n), urljoin(url, n.attrs.get("href", ""))
        if label and "href" in n.attrs and target not in links:
            links[target] = label
    minutes = f"{duration // 60_000}:{duration % 60_000 // 1000:02d}"
    parts = [
        f"# {title}", said(".hero__description"), said(".hero__byline"), said(".hero__data-item"), "## Official webinar recording", f"- Recording title: {video}", f"- Duration: {minutes}", f"- Brightcove video ID: {video_id}", f"- Official page: {url}",
        *(["## Associated Bain resources", *(f"- [{label}]({target})" for target, label in links.items())] if links else []),
        *(["## Official English captions — full transcript", transcript] if transcript else ["## Caption availability", NO_CAPTIONS]),
    ]
    return "\n\n".join(p for p in parts if p) + "\n"


#: What a talk without captions says (fixed value).
NO_CAPTIONS = "The public Bain/Brightcove playback metadata did not publish an English caption track for this recording. The official page, recording metadata, and associated report links are preserved; no transcript has been fabricated."


def webinars(rows: DataFrame, id_col: str = "id") -> DataFrame:
    """``webinar`` of (id, title, url, html, video, video_id, duration, transcript)."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [webinar(t or "", u or "", h or "", v or "", i or "", d or 0, c) for t, u, h, v, i, d, c in zip(*(batch.column(k).to_pylist() for k in range(1, 8)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [id_col, "markdown"])

    return rows.select(id_col, "title", "url", "html", "video", "video_id", F.col("duration").cast("long"), "transcript").mapInArrow(run, f"`{id_col}` {kind}, markdown string")
