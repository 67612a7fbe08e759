"""Operator 8 as a whole against a plain version, and very long texts, tokens and secrets."""

import math
import random
import re
from collections import Counter

from cases import frame
from test_maps import base

from inkwell.llm import secrets


def plain(rows):
    """Spans, live and copied base spans of each (text, owner, repository), by the definition."""
    found = []
    for text, owner, repo in rows:
        text = text or ""
        spans = [(s, k, e, re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", text[s:e])[1] if k == 0 else text[s:e]) for s, k, e in base(text)]
        tokens = []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            n = Counter(m[0])
            if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and -sum(c / len(m[0]) * math.log2(c / len(m[0])) for c in n.values()) >= 3.0:
                tokens.append((m.start(), 3, m.end(), m[0]))
        found.append((spans, tokens, text, owner, repo))
    owners = {}
    for spans, tokens, _, owner, _ in found:
        for *_, value in spans + tokens:
            owners.setdefault(value, set()).add(owner)
    live = {v: len(o) <= 2 for v, o in owners.items()}
    out = []
    for spans, tokens, *_ in found:
        more = [t for t in tokens if live[t[3]] and not any(s <= t[0] and e >= t[2] for s, _, e, _ in spans)]
        out.append((",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(spans + more)), sum(live[v] for *_, v in spans), sum(not live[v] for *_, v in spans)))
    return out


def test_scan_equals_the_plain_version(spark):
    rng = random.Random(4)
    letters = "abcdefXYZ0123456789+/_"
    values = ["".join(rng.choice(letters) for _ in range(rng.randint(12, 40))) for _ in range(25)]
    rows = [(None, "a"), ("", "a"), ("password = short", None)]
    for i in range(220):
        parts = ["plain words of a text"]
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(values[: 1 + i % 25]) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(18, 40)))
            parts.append(rng.choice([f"token: '{v}'", v, f"API_KEY={v}", f"x {v} y", "AKIA" + v.upper().replace("+", "").replace("/", "").replace("_", "")]))
        rows.append((" ".join(parts), rng.choice(["a", "b", "c", None]) if i % 4 else f"own{i % 7}"))
    rows += [rows[20]] * 4
    data = [(i, t, None, o, 0, "", 0, 0, 0, "", 0) for i, (t, o) in enumerate(rows)]
    got = {r.doc_id: (r.spans, r.n_live, r.n_copied) for r in secrets.scan(frame(spark, data)).collect()}
    want = plain([(t, o, str(i)) for i, (t, o) in enumerate(rows)])
    assert got == dict(enumerate(want))
    assert sum("token:" in x[0] for x in want) > 20 and sum(x[2] for x in want) > 20


def test_very_long_texts_tokens_and_secrets(spark):
    token = "a1B2c3D4" * 150_000
    texts = [f"{'word ' * 400_000}password = q7Xw93kLmZ0pRt5Vb8Nc2", f"secret={token}", f"{token} end", "password" + " " * 300_000 + "= q7Xw93kLmZ0pRt5Vb8Nc2", "0123456789abcdef" * 60_000]
    data = [(i, t, None, "o", 0, "", 0, 0, 0, "", 0) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in secrets.scan(frame(spark, data, 2)).collect()}
    assert got[0] == "assign:2000000:2000032"
    assert got[1] == f"assign:0:{7 + len(token)}"
    assert got[2] == f"token:0:{len(token)}"
    assert got[3] == f"assign:0:{8 + 300_000 + 2 + 21}"
    assert got[4] == f"hex:0:{len(texts[4])}"
