"""Where a page's article is when nothing marks it: points of paragraphs, handed on to the elements around them.

A paragraph with some text has points for its length and its commas. Its parent gets all of them, the parent's parent
half, those further out less and less; an element also has points for what it is and for its names, and
loses the part of them that is link text. The element with most points is the article's, with
those elements beside it that hold enough points or are paragraphs of prose.
"""

from __future__ import annotations

import re

#: Elements that are paragraphs; points of elements by what they are (fixed values).
PARAGRAPHS = frozenset("p td pre section h2 h3 h4 h5 h6".split())
POINTS = {"div": 5, "pre": 3, "td": 3, "blockquote": 3} | dict.fromkeys("address ol ul dl dd dt li form".split(), -3) | dict.fromkeys("h1 h2 h3 h4 h5 h6 th".split(), -5)
#: Elements that make a div more than a paragraph (fixed values).
BLOCKS = frozenset("blockquote dl div img ol p pre table ul h1 h2 h3 h4 h5 h6 section article main".split())
#: Names of classes and ids that speak for or against an element, and that rule it out (fixed values).
FOR = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.IGNORECASE)
AGAINST = re.compile(r"banner|combx|comment|contact|footer|gdpr|hidden|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget|(^|[-_ ])ads?([-_ ]|$)", re.IGNORECASE)
UNLIKELY = re.compile(r"banner|breadcrumbs|combx|comment|community|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|agegate|pagination|pager|popup|(^|[-_ ])ads?([-_ ]|$)", re.IGNORECASE)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.IGNORECASE)
#: Characters of a paragraph that counts, elements around it that get points, points for a name, and characters that are enough (fixed values).
SHORT, LEVELS, NAMED, ENOUGH = 25, 5, 25, 500
_KEPT = frozenset("#root html body a".split())


def spoken(node) -> str:
    """The element's text with runs of white space as one space."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
        else:
            todo += reversed(n.children)
    return re.sub(r"\s+", " ", "".join(out)).strip()


def _elements(node) -> list:
    return [c for c in node.children if not isinstance(c, str)]


def _inside(node, tag: str) -> list:
    found, todo = [], [node]
    while todo:
        n = todo.pop()
        found += [n] if n.tag == tag else []
        todo += reversed(_elements(n))
    return found


def linked(node) -> float:
    """Part of the text that is links; links within the page count less."""
    whole = len(spoken(node))
    return sum(len(spoken(a)) * (0.3 if a.attrs.get("href", "").startswith("#") else 1) for a in _inside(node, "a")) / whole if whole else 0.0


def named(node) -> int:
    """Points of an element's class and id."""
    return sum(NAMED * (bool(FOR.search(value)) - bool(AGAINST.search(value))) for value in (node.attrs.get("class", ""), node.attrs.get("id", "")) if value)


def ruled_out(node) -> bool:
    names = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return node.tag not in _KEPT and bool(UNLIKELY.search(names)) and not MAYBE.search(names)


def paragraph(node) -> bool:
    return node.tag in PARAGRAPHS or node.tag == "div" and not any(n.tag in BLOCKS for n in _descendants(node))


def _descendants(node) -> list:
    out, todo = [], _elements(node)[::-1]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += _elements(n)[::-1]
    return out


def points(root, strict: bool = True, names: bool = True) -> list[tuple]:
    """(element, points) of all elements that paragraphs gave points to, in the order in which they first did.

    ``strict``: what its names rule out has no paragraphs. ``names``: classes and ids count.
    """
    score: dict[int, list] = {}
    todo = [(root, False)]
    while todo:
        node, out = todo.pop()
        out = out or (strict and ruled_out(node))
        if out:
            continue
        todo += [(c, out) for c in reversed(_elements(node))]
        if node.parent is None or not paragraph(node):
            continue
        text = spoken(node)
        if len(text) < SHORT:
            continue
        worth = 1 + len(text.split(",")) + min(len(text) // 100, 3)
        around, level = node.parent, 0
        while around is not None and around.tag not in ("#root", "html") and level < LEVELS:
            held = score.setdefault(id(around), [around, POINTS.get(around.tag, 0) + (named(around) if names else 0)])
            held[1] += worth / (1 if level == 0 else 2 if level == 1 else level * 3)
            around, level = around.parent, level + 1
    return [(node, given * (1 - linked(node))) for node, given in score.values()]


def beside(top, found: dict[int, float]) -> list:
    """The parts of the article: the element and those beside it that belong to it, in order."""
    if top.parent is None:
        return [top]
    best = found[id(top)]
    least, out = max(10, best / 5), []
    for node in _elements(top.parent):
        bonus = best / 5 if node.attrs.get("class") and node.attrs.get("class") == top.attrs.get("class") else 0
        if node is top or (id(node) in found and found[id(node)] + bonus >= least):
            out.append(node)
        elif paragraph(node) and node.tag in ("p", "div") and not ruled_out(node):
            text, links = spoken(node), linked(node)
            if (len(text) > 80 and links < 0.25) or (0 < len(text) <= 80 and links == 0 and re.search(r"\.( |$)", text)):
                out.append(node)
    return out


def chosen(scored: list[tuple]):
    """The element with most points, or one around it that holds more or nothing else; None without points."""
    if not scored:
        return None
    found = {id(n): p for n, p in scored}
    top, best = max(scored, key=lambda x: x[1])
    least, last, around = best / 3, best, top.parent
    while around is not None and around.tag not in ("body", "html", "#root"):
        here = found.get(id(around))
        if here is not None:
            if here < least:
                break
            if here > last:
                top = around
                break
            last = here
        around = around.parent
    while top.parent is not None and top.parent.tag not in ("body", "html", "#root") and len(_elements(top.parent)) == 1:
        top = top.parent
    return top


def whole(root, strict: bool = True):
    """A copy of the page's body. ``strict``: without what its names rule out."""
    body = next((n for n in _descendants(root) if n.tag == "body"), root)
    copy = type(body)(body.tag, body.attrs)
    todo = [(body, copy)]
    while todo:
        node, made = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                made.children.append(child)
            elif child.tag not in ("head", "title") and not (strict and ruled_out(child)):
                made.children.append(type(child)(child.tag, child.attrs, made))
                todo.append((child, made.children[-1]))
    return copy


def article(root) -> list:
    """The parts of the page that are its article.

    Where they have too little text the page is looked at again with what names rule out, and then
    without regard to names; if none is enough, the longest is taken. Where all paragraphs are too short to
    count the body is taken, if it has enough text. Empty if it has not, and no paragraph counts.
    """
    tries = []
    for strict, names in ((True, True), (False, True), (False, False)):
        scored = points(root, strict, names)
        top = chosen(scored)
        if top is None:
            body = whole(root, strict)
            if len(spoken(body)) >= ENOUGH:
                return [body]
            continue
        found = {id(n): p for n, p in scored}
        found.setdefault(id(top), max(found.values()))
        parts = beside(top, found)
        size = sum(len(spoken(n)) for n in parts)
        tries.append((size, -len(tries), parts))
        if size >= ENOUGH:
            return parts
    return max(tries, key=lambda t: t[:2])[2] if tries else []
