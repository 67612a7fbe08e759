"""Short messages, labels and glossaries of the reading interface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Messages that need no search, by intent (fixed values).
INTENTS = {
    "greeting": "你好|您好|嗨|hi|hello|早上好|下午好|晚上好",
    "ability": "你是谁|你能干什么|你能做什么|你会什么|能做什么|怎么用|如何使用",
    "thanks": "谢谢|感谢|多谢|辛苦了|thankyou|thanks",
    "farewell": "再见|拜拜|回头见|bye|goodbye",
}
#: Labels of domains by id (fixed values); others are named by their title.
DOMAINS = {"legal": "企业法务", "hr": "人力资源", "retail": "零售", "supply_chain": "供应链", "finance": "财务", "marketing": "市场营销"}


def intent(message: Column) -> Column:
    """The intent of a whole message without its spaces and marks, or null."""
    plain = F.regexp_replace(F.lower(F.coalesce(message, F.lit(""))), r"(?U)[\s，。！？!?、,.]+", "")
    out = None
    for name, words in INTENTS.items():
        out = F.when(plain.rlike(f"^({words})$"), name) if out is None else out.when(plain.rlike(f"^({words})$"), name)
    return out


def domain_label(domain: Column, title: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, domain), F.regexp_replace(title, r"\s*AI\s*机会雷达\s*$", ""))


def glossary(source) -> dict[str, list[str]]:
    """Preferred terms with their prohibited variants, from any of the accepted shapes.

    A mapping or a list of entries; an entry is the preferred text, a list of variants, or an
    object under several names for both.
    """
    pairs = [(e.get("term") or e.get("english") or str(i), e) for i, e in enumerate(source)] if isinstance(source, list) else list((source or {}).items())
    out: dict[str, list[str]] = {}
    for term, entry in pairs:
        if isinstance(entry, str):
            preferred, variants = entry, [term]
        elif isinstance(entry, list):
            preferred, variants = term, entry
        elif isinstance(entry, dict):
            preferred = entry.get("preferred") or entry.get("defaultChinese") or entry.get("translation") or term
            variants = next((entry[k] for k in ("prohibited", "prohibitedVariants", "forbidden", "disallowed") if entry.get(k)), [])
            variants = variants if isinstance(variants, list) else [variants]
        else:
            continue
        out.setdefault(preferred, []).extend(v for v in variants if isinstance(v, str) and v)
    return out
