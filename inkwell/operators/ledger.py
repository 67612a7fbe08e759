"""The article ledger: candidates, refresh records, merging, taxonomy, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import scores, urls

VERSION = "zh-management-v1"

#: Canonical topics and their aliases (fixed values).
TOPICS = {
    "AI 战略与价值": ["AI战略与价值", "AI 战略与价值", "strategy-value", "ai-operating-model", "operating-model-agents", "enterprise-workflows"],
    "战略、增长与行业洞察": ["战略与行业观察", "战略、增长与行业洞察", "strategy-growth-transformation", "industry-market-signals", "macro-risk-geopolitics", "risk-geopolitics", "ecosystem-policy", "innovation-methods"],
    "客户、品牌与零售": ["消费者、品牌与营销", "客户、增长与商业模式", "客户、品牌与零售", "consumer-brand-retail", "consumer-brand", "retail-fashion"],
    "运营、供应链与成本": ["运营、供应链与成本", "operations-supply-chain", "operations"],
    "财务、投资与资本": ["财务、投资与资本", "finance-investment-ma", "finance-functional-use", "strategy-finance"],
    "组织、人才与工作": ["组织、人才与变革", "组织、人才与工作", "organization-leadership-talent", "organization-work", "organization", "organization-talent"],
    "技术、数据与架构": ["技术、数据与架构", "数据、平台与基础设施", "ai-digital-platform", "agent-architecture", "architecture-data", "data-architecture", "models-platform"],
    "治理、风险与安全": ["治理、风险与安全", "safety-governance", "governance-risk-trust", "cyber-resilience"],
    "可持续发展与韧性": ["可持续与韧性", "可持续发展与韧性", "sustainability-resilience"],
    "前沿研究与社会影响": ["前沿研究与技术", "前沿研究与社会影响", "physical-science", "economics-society"],
}

#: Ordered classification rules: pattern, category, domains; then the default (fixed values).
RULES = [
    ("safety|safeguard|security|cyber|risk|govern|trust|vendor lock|cryptograph|治理|安全|风险|信任", "治理、风险与安全", ["AI Governance", "Cybersecurity"]),
    (r"workforce|worker|talent|hr\b|human resources|productivity|adoption|fluency|retraining|organization|人才|员工|生产力|采用", "组织、人才与变革", ["Workforce Transformation", "Change Management"]),
    (r"agentic|agent\b|operating model|transformation|enterprise|procurement|business services|智能体|运营模式|采购|转型", "AI战略与价值", ["AI Transformation", "Operating Model"]),
    ("infrastructure|data center|architecture|cloud|compute|semiconductor|基础设施|数据中心|架构|算力", "数据、平台与基础设施", ["Enterprise Architecture", "AI Infrastructure"]),
    ("growth|sales|commercial|marketing|retail|store|customer|category management|增长|销售|营销|零售|客户", "客户、增长与商业模式", ["Growth", "Customer Experience"]),
    ("research|science|biology|riemann|climate|experiment|研究|科学|生物|黎曼|气候", "前沿研究与技术", ["AI Research", "Science"]),
]
DEFAULT = ("AI战略与价值", ["AI Transformation"])

#: Signs of evidence and of application, and the points they give (fixed values).
EVIDENCE = "study|survey|research|case|evidence|measured|experiment|benchmark|研究|调查|案例|证据|实验|数据"
APPLIED = "how |guide|building|transform|procurement|operations|growth|strategy|指南|转型|运营|战略"
POINTS = {"evidence": (27, 20, 21, 12), "applied": (25, 20, 21, 9), "other": (23, 19, 20, 9)}


def topic(col: Column) -> Column:
    """The canonical topic of an alias; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for name, aliases in TOPICS.items() for alias in aliases for x in (alias, name)])
    return F.try_element_at(table, col)


def migrate(articles: DataFrame, at: Column) -> DataFrame:
    """Topics made canonical, with what they were; unknown topics stay null in ``category`` for a check to find."""
    return articles.select(
        F.col("id").alias("article_id"), F.col("category").alias("topic_from"), topic(F.col("category")).alias("topic_to"),
        F.when(F.col("category") == topic(F.col("category")), "identity").otherwise("alias").alias("mapping_rule"), F.lit(VERSION).alias("taxonomy_version"), at.alias("migrated_at"),
    )


#: Where a word of the rules ends: before anything but an ASCII letter, digit or underscore. A letter
#: with a mark ends it too, as in the reference and in SQL; Java's own mark goes by Unicode.
WORD_END = "(?![0-9A-Za-z_])"


def classify(text: Column) -> Column:
    """The first matching rule's category and domains."""
    out = F.lit(None)
    for i, (pattern, name, domains) in enumerate(RULES):
        pattern = pattern.replace(r"\b", WORD_END)
        verdict = F.struct(F.lit(name).alias("primary"), F.array(*map(F.lit, domains)).alias("domains"))
        out = F.when(text.rlike(f"(?i){pattern}"), verdict) if i == 0 else out.when(text.rlike(f"(?i){pattern}"), verdict)
    return out.otherwise(F.struct(F.lit(DEFAULT[0]).alias("primary"), F.array(*map(F.lit, DEFAULT[1])).alias("domains")))


def points(text: Column) -> Column:
    """Additive points and their total by the signs in a text."""

    def of(kind):
        values = POINTS[kind]
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(scores.MAXIMA, values, strict=True)], F.lit(sum(values)).alias("total"))

    return F.when(text.rlike(f"(?i){EVIDENCE}"), of("evidence")).when(text.rlike(f"(?i){APPLIED}"), of("applied")).otherwise(of("other"))


def coverage(candidates: DataFrame) -> DataFrame:
    """Counts by status, and whether discovered = included + excluded + failed."""
    by = {s: F.count_if(F.col("status") == s) for s in ("included", "excluded", "failed")}
    return candidates.agg(F.count("*").alias("discovered"), *[c.alias(s) for s, c in by.items()]).withColumn("closed", F.col("discovered") == F.col("included") + F.col("excluded") + F.col("failed"))


def candidate_violations(candidates: DataFrame, domains: Column) -> DataFrame:
    """One row per broken rule of a candidate: status, HTTPS, domain, reason, date, repeated URL."""
    repeated = F.count("*").over(Window.partitionBy(urls.merge_key(F.col("url")))) > 1
    rules = {
        "status": ~F.coalesce(F.col("status").isin("included", "excluded", "failed"), F.lit(False)),
        "https": ~F.coalesce(F.col("url").startswith("https://"), F.lit(False)),
        "domain": ~F.coalesce(urls.allowed(F.col("url"), domains), F.lit(False)),
        "reason": (F.col("status") != "included") & (F.coalesce(F.col("reason"), F.lit("")) == ""),
        "date": F.col("published_at").isNotNull() & ~scores.strict_date(F.col("published_at")),
        "repeated_url": F.coalesce(repeated, F.lit(False)),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return candidates.withColumn("violations", found).select("candidate_id", F.explode("violations").alias("violation"))


def duplicates(rows: DataFrame, id_col: str = "id", url_col: str = "url") -> DataFrame:
    """Identities that occur more than once: by id, then by merge key of the URL."""
    ids = rows.groupBy(F.col(id_col).cast("string").alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("id"))
    keys = rows.groupBy(urls.merge_key(F.col(url_col)).alias("value")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("url"))
    return ids.unionByName(keys).where("n > 1").select("kind", "value", "n")


def merge(existing: DataFrame, additions: DataFrame, strict: bool = False) -> DataFrame:
    """Existing rows and then the additions whose id and URL are new (``ordinal`` orders both).

    Of additions with one id the first counts, and then of those with one URL the first. Rows
    without an id or a URL share none. ``strict`` fails on the first repeated identity instead,
    within either side as well.
    """
    if strict:
        found = duplicates(existing.select("id", "url").unionByName(additions.select("id", "url"))).where("value is not null").limit(1).collect()
        if found:
            raise ValueError(f"repeated {found[0].kind}: {found[0].value}")
    fresh = additions.withColumn("_key", urls.merge_key(F.col("url"))).join(existing.select("id"), "id", "left_anti")
    fresh = fresh.join(existing.select(urls.merge_key(F.col("url")).alias("_key")), "_key", "left_anti")
    # The least ordinal of an identity is found by an aggregate: a value in many rows stays one row a task.
    for name in ("id", "_key"):
        first = fresh.where(F.col(name).isNotNull()).groupBy(name).agg(F.min("ordinal").alias("_first"))
        fresh = fresh.join(first, name, "left").where(F.col(name).isNull() | (F.col("ordinal") == F.col("_first"))).drop("_first")
    return existing.withColumn("origin", F.lit("existing")).unionByName(fresh.select(*additions.columns).withColumn("origin", F.lit("addition")))


def refresh(candidates: DataFrame, overrides: DataFrame, existing: DataFrame) -> DataFrame:
    """Ledger records of included candidates: title, slug id, category, points, priority and next index.

    Indexes go on from each publisher's largest; slugs that are taken get -2, -3 and so on.
    """
    key = F.lower(urls.canonical(F.col("url")))
    included = candidates.where("status = 'included'").withColumn("key", key)
    titles = overrides.select(F.lower(urls.canonical(F.col("url"))).alias("key"), "title_zh", "title_original")
    rows = included.join(titles, "key", "left").withColumn("title", F.coalesce("inspected_title", "title_original"))
    last = existing.groupBy("publisher").agg(F.max("archive_index").alias("last_index"))
    rows = rows.join(last, "publisher", "left")
    order = Window.partitionBy("publisher").orderBy("candidate_id")
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("title_zh", F.lit("")))
    base = F.concat(F.regexp_replace(F.lower("publisher"), "[^a-z0-9]+", "-"), F.lit("-"), urls.slug(F.col("url")))
    rows = rows.withColumn("points", points(text)).withColumn("class", classify(text)).withColumn("base", base)
    turn = F.row_number().over(Window.partitionBy("base").orderBy("candidate_id"))
    return rows.select(
        "candidate_id", "publisher", F.when(turn == 1, F.col("base")).otherwise(F.concat_ws("-", "base", turn.cast("string"))).alias("id"),
        urls.canonical(F.col("url")).alias("canonical_url"), "title", "title_zh", F.col("class.primary").alias("category"), F.col("points.total").alias("total"),
        scores.tier(F.col("points.total")).alias("tier"), scores.priority(F.col("points.total")).alias("priority"),
        (F.coalesce("last_index", F.lit(0)) + F.row_number().over(order)).cast("long").alias("archive_index"),
    )


def record_violations(articles: DataFrame) -> DataFrame:
    """One row per broken rule of a ledger record: required fields, HTTPS, ranges, additive total."""
    dims = list(scores.MAXIMA)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    rules = [(empty(c), f"missing {c}") for c in ("id", "publisher", "source_url", "title", "priority")]
    rules.append((~F.coalesce(F.col("source_url").startswith("https://"), F.lit(False)), "source_url is not https"))
    given = reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in dims])
    rules += [(given & ~F.coalesce((F.col(d) == F.floor(d)) & F.col(d).between(0, most), F.lit(False)), f"{d} out of range") for d, most in scores.MAXIMA.items()]
    total = reduce(lambda a, b: a + b, [F.col(d) for d in dims])
    rules.append((given & ~F.coalesce(total == F.col("total"), F.lit(False)), "total is not the sum"))
    found = F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))
    return articles.withColumn("v", found).select("row_id", F.explode("v").alias("violation"))


def record_errors(articles: DataFrame) -> DataFrame:
    """One row per broken rule of a full ledger record: seven required fields, HTTPS, and points where there are any (place, error)."""
    dims = list(scores.MAXIMA)
    required = ("id", "radar_title", "publisher", "source_url", "title_original", "priority", "provenance")
    rules = [(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", f"missing {c}") for c in required]
    rules.append((F.col("source_url").isNotNull() & ~F.col("source_url").startswith("https://"), "source_url is not https"))
    given = reduce(lambda a, b: a | b, [F.col(d).isNotNull() for d in dims])
    fits = {d: F.coalesce((F.col(d) == F.floor(d)) & F.col(d).between(0, most), F.lit(False)) for d, most in scores.MAXIMA.items()}
    rules += [(given & ~fits[d], f"invalid {d}") for d in dims]
    total = reduce(lambda a, b: a + b, [F.col(d) for d in dims])
    rules.append((given & reduce(lambda a, b: a & b, fits.values()) & ~F.coalesce(total == F.col("total"), F.lit(False)), "total is not the sum"))
    found = F.array_compact(F.array(*[F.when(broken, F.lit(text)) for broken, text in rules]))
    return articles.select("place", F.explode(found).alias("error"))


def override_join(ledger: DataFrame, archived: DataFrame, columns: list[str]) -> DataFrame:
    """Archived metadata under the ledger: a ledger column wins even where it is null."""
    right = archived.select("id", *[F.col(c).alias(f"archived_{c}") for c in archived.columns if c not in ("id", *columns)])
    return ledger.join(right, "id", "left")


def change_status(before: DataFrame, after: DataFrame) -> DataFrame:
    """new, changed, unchanged or removed by fingerprint; a null fingerprint is a value of its own."""
    a = before.select("id", F.col("fingerprint").alias("old"), F.lit(True).alias("was"))
    b = after.select("id", F.col("fingerprint").alias("new"), F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return a.join(b, "id", "full").select("id", state.alias("change"))


def union_scan(*digests: DataFrame) -> DataFrame:
    """Records of several digests in one table; fails where an id or a canonical URL occurs twice."""
    rows = digests[0]
    for other in digests[1:]:
        rows = rows.unionByName(other, allowMissingColumns=True)
    found = duplicates(rows.select("id", urls.canonical(F.col("source_url")).alias("url"))).where("value is not null").orderBy("kind", "value").head()
    if found:
        raise ValueError(f"repeated {found.kind}: {found.value}")
    return rows
