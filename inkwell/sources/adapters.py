"""Digests of four layouts into one record model, by each layout's own field rules.

A rule says where a field is: an attribute of the card (``@name``), the text of the first element
for a selector, its part in one language (``selector|en``), or either of these in the section
below a heading (``pattern >> selector``). Rules are tried in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import urls
from inkwell.sources.digests import Node, tree

#: Field rules by layout (fixed values).
ADAPTERS: dict[str, dict] = {
    "bcg": {
        "card": "article.article-card", "id": ["@id"], "title_original": ["h3"], "title_zh": [".translated-title"], "date": [".date"], "topics": ["@data-categories"], "priority": ["@data-priority", ".priority"],
        "score": [".score"], "scale": 10, "confidence_reason": ["CDIO Office >> .confidence"], "confidence": ["CDIO Office >> .confidence"], "core_zh": ["核心观点 >> p"], "impact_zh": ["^影响面$ >> p", "^影响面$ >> *"], "implication_zh": ["Amer Sports / Salomon >> p"],
        "evidence": "关键证据 >> p", "chips": True,
    },
    "bilingual-analysis": {
        "card": "article.analysis-card", "id": ["@data-radar-id", "@id"], "title_original": [".original-title", "h3|en"], "title_zh": ["h3|zh"], "date": [".eyebrow"], "iso": True, "topics": ["@data-category"], "priority": ["@data-priority"],
        "score": ["@data-score"], "scale": 100, "dimensions": ".chips >", "confidence_reason": ["footer p|zh", "footer p"], "confidence": [".chips >"], "core_original": [".take p|en"], "core_zh": [".take p|zh"],
        "impact_zh": ["影响范围|Impact >> p|zh"], "implication_zh": ["section.implication p|zh"], "evidence": "关键证据|Key evidence",
    },
    "mit": {
        "card": "article.article-card", "id": ["@data-radar-id", "@id"], "title_original": [".source-title", "h3|en"], "title_zh": ["h3|zh"], "date": ["footer span"], "iso": True, "topics": ["@data-category"], "priority": ["@data-priority"],
        "score": ["@data-score"], "scale": 100, "ordered": "footer .metric", "confidence_reason": ["zh: .confidence"], "confidence": ["zh: .confidence"], "core_original": ["en: Core view >> p"], "core_zh": ["zh: 核心观点 >> p"],
        "impact_zh": ["zh: ^影响$ >> p"], "implication_zh": ["zh: Salomon >> p"], "evidence": "pairs",
    },
    "bain": {
        "card": "article.article-card", "id": ["@data-radar-id", "@id"], "title_original": [".original-title", "h3|en"], "title_zh": ["h3|zh"], "date": [".eyebrow"], "iso": True, "topics": ["@data-category"], "priority": ["@data-priority"],
        "score": ["@data-score"], "scale": 100, "dimensions": ".scoreline", "confidence_reason": ["p.confidence"], "confidence": [".scoreline"], "core_original": [".core|en"], "core_zh": [".core|zh"],
        "impact_zh": ["影响范围|Impact >> p|zh"], "implication_zh": ["Salomon >> p|zh"], "evidence": "关键证据|Key evidence",
    },
}
#: Labels of the four dimensions, and where a card's source link is, in turn (fixed values).
DIMENSIONS = {"content": r"(?:CV|Content)\s*(\d+)", "impact": r"(?:IB|Impact)\s*(\d+)", "relevance": r"(?:SR|Relevance)\s*(\d+)", "evidence": r"(?:ES|Evidence)\s*(\d+)"}
LINKS = ["a.source-link", "footer a", ".article-footer a", "a"]

#: Records that leave a worker at once.
ROWS = 500
_STRINGS = ["id", "element_id", "title_original", "title_zh", "published_at", "document_type", "author", "category", "priority", "tier", "confidence", "confidence_reason", "core_original", "core_zh", "impact_zh", "implication_zh", "source_url"]
_LISTS = ["topics", "geography", "horizon", "domains"]
_SCHEMA = pa.schema([
    ("digest", pa.string()), *((c, pa.string()) for c in _STRINGS), *((c, pa.list_(pa.string())) for c in _LISTS), ("score", pa.float64()), ("scale", pa.int32()), *((d, pa.int32()) for d in DIMENSIONS.keys()),
    ("proofs", pa.list_(pa.struct([("original", pa.string()), ("zh", pa.string()), ("locator", pa.string())]))),
])
_DDL = ", ".join(["digest string", *(f"{c} string" for c in _STRINGS), *(f"{c} array<string>" for c in _LISTS), "score double", "scale int", *(f"{d} int" for d in DIMENSIONS), "proofs array<struct<original:string,zh:string,locator:string>>"])


def said(node: Node | None, without: tuple[str, ...] = ()) -> str:
    """The text of an element, parts that match a selector left out."""

    def parts(n: Node) -> Iterator[str]:
        for c in n.children:
            if isinstance(c, str):
                yield c
            elif not any(c.matches(s) for s in without):
                yield from parts(c)

    return re.sub(r"\s+", " ", "".join(parts(node))).strip() if node else ""


def first(root: Node | None, selector: str) -> Node | None:
    return next(iter(root.find(selector)), None) if root else None


def in_language(node: Node | None, language: str) -> str:
    return said(first(node, f"[data-lang-content={language}]") or node)


def section(root: Node | None, pattern: str) -> Node | None:
    """The section around the first heading that a pattern finds."""
    for heading in root.find("h4") if root else []:
        if re.search(pattern, said(heading)):
            around = heading.parent
            while around and around.tag != "section":
                around = around.parent
            if around:
                return around
    return None


def place(card: Node, rule: str) -> str:
    """What a rule finds in a card, or nothing."""
    if rule.startswith("@"):
        return card.attrs.get(rule[1:], "").strip()
    root: Node | None = card
    if rule[:4] in ("zh: ", "en: "):
        root, rule = next((n for n in card.find(".article-body") if n.attrs.get("data-lang-content") == rule[:2]), None), rule[4:]
    if ">>" in rule:
        pattern, rule = rule.split(" >> ")
        root = section(root, pattern)
    if rule == "*":
        return said(root)
    if rule.endswith(" >"):
        return " ".join(chips(card))
    selector, _, language = rule.partition("|")
    found = first(root, selector)
    return in_language(found, language) if language else said(found)


def chips(card: Node) -> list[str]:
    return [said(c) for holder in card.find(".chips") for c in holder.children if isinstance(c, Node) and c.tag == "span"]


def proofs(card: Node, rule: str) -> list[dict]:
    """The statements of a card's evidence in both languages, and where they are from."""
    if rule == "pairs":
        bodies = [next((n for n in card.find(".article-body") if n.attrs.get("data-lang-content") == x), None) for x in ("zh", "en")]
        zh, en = ([*n.find("li")] if (n := first(body, ".evidence")) else [] for body in bodies)
        out = []
        for k, item in enumerate(zh):
            other = en[k] if k < len(en) else None
            locator = next((x for i in (item, other) if i and (x := re.sub(r"\s+", " ", "".join(said(s) for s in i.find("small"))).strip())), None)
            out.append({"original": said(other, ("small",)) or None, "zh": said(item, ("small",)) or None, "locator": locator})
        return out
    if ">>" in rule:
        text = place(card, rule)
        return [{"original": None, "zh": text, "locator": None}] if text else []
    around = section(card, rule)
    out = []
    for item in (around.find("li") or around.find("p")) if around else []:
        zh = said(first(item, "[data-lang-content=zh]")) or said(item, ("small", "a.locator"))
        en = said(first(item, "[data-lang-content=en]"))
        where = [n for n in item.all() if n.matches("a.locator") or n.tag == "small"]
        if zh or en:
            out.append({"original": en or None, "zh": zh or None, "locator": said(where[-1]) or None if where else None})
    return out


def record(card: Node, rules: dict, publisher: str) -> dict:
    get = lambda name: next((v for r in rules.get(name, ()) if (v := place(card, r))), None)
    raw = get("id") or ""
    row: dict = {c: get(c) for c in ("title_original", "title_zh", "confidence_reason", "core_original", "core_zh", "impact_zh", "implication_zh")}
    if rules.get("dimensions") == ".scoreline" and row["title_original"]:
        row["title_original"] = re.sub(r"^Original\s*·\s*", "", row["title_original"], flags=re.IGNORECASE) or place(card, "h3|en")
    date = get("date") or ""
    found = re.search(r"\d{4}-\d{2}-\d{2}", date)
    row["published_at"] = (found[0] if found else None) if rules.get("iso") else date or None
    topics = [t for t in (get("topics") or "").split("|") if t]
    meta, labels = [said(n) for n in card.find(".meta span")], chips(card)
    kind = next((x for x in labels if not re.match(r"(must-read|track|reference)$|confidence:", x, re.IGNORECASE) and not re.search(r"(?:CV|Content)\s*\d+", x, re.IGNORECASE)), None)
    if rules.get("chips"):
        kind = meta[0] if meta else None
    elif rules.get("dimensions") == ".scoreline":
        kind = said(first(card, ".eyebrow")).split("·")[-1].strip()
    elif rules.get("ordered"):
        kind = None
    score, tier = get("score") or "", None
    if rules["scale"] == 10:
        stated = re.search(r"(High|Medium|Low)\s*·\s*(\d+)\s*/\s*10", score, re.IGNORECASE)
        score, tier = (stated[2], stated[1].lower()) if stated else ("0", None)
    points: dict[str, int | None] = dict.fromkeys(DIMENSIONS)
    if "dimensions" in rules:
        text = place(card, rules["dimensions"])
        labelled = {d: m for d, p in DIMENSIONS.items() if (m := re.search(p, text, re.IGNORECASE))}
        if len(labelled) == len(DIMENSIONS):
            points = {d: int(m[1]) for d, m in labelled.items()}
    elif "ordered" in rules and len(given := re.findall(r"(\d+)\s*/\s*(?:35|25|15)", place(card, rules["ordered"]))) >= 4:
        points = {d: int(v) for d, v in zip(DIMENSIONS, given, strict=False)}
    level = re.search(r"\b(high|middle|medium|low)\b", get("confidence") or "", re.IGNORECASE)
    links = (a.attrs["href"] for s in LINKS for a in reversed(card.find(s)) if a.attrs.get("href", "").startswith("http"))
    tags = {c: [said(n) for n in card.find(f".chip.{css}")] if rules.get("chips") else [] for c, css in (("geography", "geo"), ("horizon", "horizon"), ("domains", "domain"))}
    return row | points | tags | {
        "id": f"{re.sub(r'[^a-z0-9]+', '-', publisher.lower())}-{re.sub('^article-', '', raw)}", "element_id": card.attrs.get("id") or raw, "document_type": kind or "article", "author": meta[1] if rules.get("chips") and len(meta) > 1 else None,
        "category": topics[0] if topics else "uncategorized", "topics": topics, "priority": re.sub(r"\s+", "-", (get("priority") or "").lower()), "tier": tier, "score": float(score) if re.fullmatch(r"\d+(\.\d+)?", score) else None, "scale": rules["scale"],
        "confidence": {"medium": "middle"}.get(level[1].lower(), level[1].lower()) if level else "unknown", "source_url": next(links, None), "proofs": proofs(card, rules["evidence"]),
    }


def records(html: str | Node, adapter: str, publisher: str) -> list[dict]:
    """The records of a digest, as text or parsed."""
    if adapter not in ADAPTERS:
        raise ValueError(f"unknown adapter {adapter}")
    rules, root = ADAPTERS[adapter], tree(html) if isinstance(html, str) else html
    return [record(card, rules, publisher) for card in root.find(rules["card"])]


def scan(digests: DataFrame) -> DataFrame:
    """Records of digests (digest, html, adapter, publisher, title, expected); a title or count that differs fails the scan, null ones are not checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[dict] = []
        for batch in batches:
            for digest, html, adapter, publisher, title, expected in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                root = tree(html or "")
                if title is not None and (actual := said(first(root, "title"))) != title:
                    raise ValueError(f"{digest}: title {actual} is not {title}")
                found = records(root, adapter, publisher or "")
                if expected is not None and len(found) != expected:
                    raise ValueError(f"{digest}: expected {expected} records, found {len(found)}")
                made += [{"digest": digest, **r} for r in found]
                if len(made) >= ROWS:
                    yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)
                    made = []
        yield pa.RecordBatch.from_pylist(made, schema=_SCHEMA)

    rows = digests.select("digest", "html", "adapter", "publisher", "title", F.col("expected").cast("int")).mapInArrow(run, _DDL)
    return rows.withColumn("canonical_url", urls.canonical(F.col("source_url")))
