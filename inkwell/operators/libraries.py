"""Scenario libraries built from a plan and its sources, and checked by all of their rules.

A built scenario is one wide row; a check is one row (library, place, error) for each broken
rule, so that all errors of a library come together and a failing mode is a choice of the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions import scores
from inkwell.operators import decisions

#: What a built scenario says, by field; names in braces are columns of the plan.
TEMPLATES = {
    "problem": [
        "{focus}目前依赖人工经验和分散规则，响应慢且难以稳定复制。",
        "{inputs}分散在不同系统、文档或团队，业务人员难以及时形成同一版本的判断。",
        "高峰期、长尾任务和“{exception}”等例外会放大遗漏、返工与服务不一致。",
    ],
    "ai_value": [
        "在权限范围内连接{inputs}，形成可追溯的任务上下文。",
        "持续识别与“{focus}”有关的模式、异常和待办，并说明触发原因。",
        "生成“{output}”的建议草稿、备选方案及其业务影响，供负责人选择。",
        "对低置信度、规则冲突和“{exception}”自动暂停，转交具名人员复核。",
    ],
    "human_handoff": ["当模型无法给出证据、触发“{exception}”或动作会影响客户、员工、供应商、现金或合规时，由{owner}审批后再执行。"],
    "acceptance_metrics": [
        "{kpi}较试点前四周基线改善至少 10%，并披露样本量与异常值处理。",
        "人工复核一次通过率达到 90%，所有修改均记录原因并可追溯到来源。",
        "触发“{exception}”的任务 100% 转交具名负责人，未发生未经批准的自动动作。",
    ],
    "rationale": ["{focus}的业务影响和流程频率较明确；排序同时考虑数据就绪、证据强度与风险可控性。"],
    "prerequisite": ["确认{inputs}的数据责任人、合法用途、基线口径、人工复核人与回退流程。"],
}
#: Levels of confidence with their reasons, and defaults of what a plan or source leaves out.
CONFIDENCE = {
    "backed": ("high", "研究依据与企业公开实践相互补充，但收益仍需用本企业基线复验。"),
    "risky": ("middle", "风险边界有明确治理依据，但不同司法辖区和业务情境仍需专项评估。"),
    "public": ("middle", "公开资料支持方向判断；具体效果多为企业或供应商自报，不能直接外推。"),
}
VENDOR, OWNER, CASE_TYPE, MARKET, BASIS = "供应商观点", "具名业务负责人", "公司披露", "中国", "企业或供应商公开披露，非独立增量实验。"
PILOT_SCOPE = "选一个业务单元，用历史样本离线评测两周，再开展 8–12 周受控试点；只开放建议与草稿，不开放不可逆动作。"
#: What a value may be.
CASE_TYPES, MARKETS, LEVELS, WINDOWS = ["客户案例", "公司披露", "研究案例", "警示案例"], ["中国", "国际"], ["high", "middle", "low"], ["current", "legacy_reference"]


def _said(template: str) -> Column:
    """A template with the plan's columns in its braces."""
    parts = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        if piece:
            parts.append(F.coalesce(F.col(piece), F.lit("")) if k % 2 else F.lit(piece))
    return F.concat(*parts)


def built(plan: DataFrame, sources: DataFrame, default_secondary: str | None = None) -> DataFrame:
    """Scenarios of a plan (library, ordinal, title, short_title, category, risk, focus, inputs, exception, output, kpi, owner, research_id, case_id, secondary_id, priority).

    Sources (library, source_id, publisher, evidence_type, fact, locator, evidence_window, company,
    case_summary, case_type, caveat, market, basis) are looked up three times: research, case, and a second
    research that defaults to one of the library. Only the first priority cites the second; ids
    stay distinct and in this order. A source that isn't there leaves its parts null for a check to find.
    """
    given = F.nullif("given", F.lit(""))
    rows = decisions.build(plan.withColumnRenamed("priority", "given") if "priority" in plan.columns else plan.withColumn("given", F.lit(None).cast("string")))
    rows = rows.withColumn("priority", F.coalesce(given, "priority")).drop("value", "total", "red_line", *decisions.DIMENSIONS)
    cards = F.create_map(*[x for p, values in decisions.SCORECARDS.items() for x in (F.lit(p), F.array(*map(F.lit, values)))])
    for k, name in enumerate(decisions.DIMENSIONS):
        rows = rows.withColumn(name, F.element_at(cards, F.col("priority"))[k])
    rows = rows.withColumn("owner", F.coalesce(F.nullif("owner", F.lit("")), F.lit(OWNER))).withColumn("second", F.coalesce(F.nullif("secondary_id", F.lit("")), F.lit(default_secondary).cast("string")))
    facts = F.struct(*[c for c in sources.columns if c != "library"])
    # Sources grow with the libraries, and what derives them may hide that from the planner: no copy of all of them in each executor.
    sources = sources.hint("merge")
    for name, key in (("research", "research_id"), ("case", "case_id"), ("extra", "second")):
        rows = rows.join(sources.select("library", F.col("source_id").alias(key), facts.alias(name)), ["library", key], "left")
    first = F.col("priority") == "P0"
    ids = F.when(first, F.array("research.source_id", "extra.source_id", "case.source_id")).otherwise(F.array("research.source_id", "case.source_id"))
    kind = F.when(first & (F.coalesce(F.col("research.evidence_type"), F.lit("")) != VENDOR), "backed").when(F.col("priority") == "P3", "risky").otherwise("public")
    table = F.create_map(*[x for name, (level, reason) in CONFIDENCE.items() for x in (F.lit(name), F.struct(F.lit(level).alias("level"), F.lit(reason).alias("reason")))])
    red = F.col("priority") == "P3"
    by = lambda *v: F.element_at(F.create_map(*[x for p, n in zip(("P0", "P1", "P2", "P3"), v, strict=True) for x in (F.lit(p), F.lit(n))]), F.col("priority"))
    texts = {name: F.array(*map(_said, pieces)) if len(pieces) > 1 else _said(pieces[0]) for name, pieces in TEMPLATES.items()}
    fact = lambda s: F.struct(F.col(f"{s}.source_id").alias("source_id"), F.col(f"{s}.fact").alias("text"), F.col(f"{s}.locator").alias("locator"))
    case = F.struct(
        F.col("case.company").alias("company"), F.col("case.case_summary").alias("summary"), F.col("case.source_id").alias("source_id"), F.coalesce("case.case_type", F.lit(CASE_TYPE)).alias("case_type"),
        F.col("case.caveat").alias("caveat"), F.coalesce("case.market", F.lit(MARKET)).alias("market"), F.coalesce("case.basis", F.lit(BASIS)).alias("basis"),
    )
    return rows.select(
        "library", "i", F.concat_ws("-", "library", "number").alias("id"), "number", "title", "short_title", "priority", "category", "risk",
        *[c.alias(n) for n, c in texts.items()], by(5.0, 4.5, 4.0, 3.5).alias("value"), by(4.5, 4.0, 3.5, 1.5).alias("feasibility"), "x", "y", (~red).alias("matrix_eligible"), "matrix_rank",
        F.element_at(table, kind).alias("confidence"), F.coalesce("research.evidence_window", F.lit("current")).alias("evidence_window"), F.array(fact("research"), fact("case")).alias("source_facts"),
        *decisions.DIMENSIONS, reduce(lambda a, b: a + b, map(F.col, decisions.DIMENSIONS)).alias("total"), red.alias("red_line"), F.array_distinct(F.array_compact(ids)).alias("evidence_ids"), F.array(case).alias("company_cases"),
    )


def pilots(scenarios: DataFrame, most: int = 3) -> DataFrame:
    """A pilot for each of the first ``most`` scenarios of first priority of a library."""
    place = F.row_number().over(Window.partitionBy("library").orderBy("i"))
    rows = scenarios.where("priority = 'P0'").withColumn("place", place).where(F.col("place") <= most)
    return rows.select(
        "library", (F.col("place") - 1).alias("i"), F.concat("library", F.lit("-pilot-"), "place").alias("id"), F.col("id").alias("scenario_id"), F.concat(F.lit("优先启动 "), F.format_string("%02d", "place")).alias("label"),
        "title", F.lit(PILOT_SCOPE).alias("scope"), F.array_join("acceptance_metrics", " ").alias("acceptance"),
    )


def _blank(col: Column | str) -> Column:
    return F.trim(F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))) == ""


def _texts(col: str, least: int) -> list[tuple[Column, str]]:
    """A list of texts: enough of them, none empty."""
    return [(F.coalesce(F.size(col), F.lit(-1)) < least, f"{col} must have {least} entries"), (F.exists(F.coalesce(F.col(col), F.array().cast("array<string>")), _blank), f"{col} must not have empty entries")]


def _broken(rows: DataFrame, place: Column, rules: list[tuple[Column, str]]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(error)) for rule, error in rules]))
    return rows.select("library", place.alias("place"), F.explode(found).alias("error"))


def scenario_errors(scenarios: DataFrame, ranked: bool = True, extended: bool = True) -> DataFrame:
    """Rules on single scenarios; ranked and extended libraries have more of them."""
    total = reduce(lambda a, b: a + b, [F.when(F.col(d).between(0, m), F.col(d)).otherwise(0) for d, m in decisions.MAXIMA.items()])
    inside = lambda c, a, b: F.coalesce(F.col(c).between(a, b), F.lit(False))
    p, t, red = F.col("priority"), F.col("total"), F.coalesce("red_line", F.lit(False))
    rules = [(_blank(c), f"{c} must be text") for c in ("id", "number", "title", "short_title", "priority", "category", "risk", "rationale", "prerequisite")]
    rules += [
        (~F.coalesce(F.col("title").rlike("^(用 AI|让 AI)"), F.lit(False)), "title must start with 用 AI or 让 AI"), (~_blank("short_title") & ~F.length("short_title").between(4, 14), "short_title must have 4 to 14 characters"),
        (~F.coalesce(F.col("number").rlike(r"^\d{2}$"), F.lit(False)), "number must have two digits"), (~F.coalesce(p.isin("P0", "P1", "P2", "P3"), F.lit(False)), "priority is unknown"), (F.col("red_line").isNull(), "red_line must be true or false"),
        *_texts("problem", 3), *_texts("ai_value", 4), *[(~inside(d, 0, m), f"{d} must be from 0 to {m}") for d, m in decisions.MAXIMA.items()], (~F.coalesce(t == total, F.lit(False)), "total must be the sum of the dimensions"),
        ((p == "P0") & ((t < 80) | red), "P0 needs 80 points and no red line"), ((p == "P1") & (~t.between(65, 79) | red), "P1 needs 65 to 79 points and no red line"),
        ((p == "P2") & ((t < 50) | red | ((t > 64) & _blank("prerequisite"))), "P2 needs 50 to 64 points, or a prerequisite, and no red line"), ((p == "P3") & ~red, "P3 needs a red line"),
        *[(~inside(c, 1, 5), f"{c} must be from 1 to 5") for c in ("value", "feasibility")], *[(~inside(c, 0, 100), f"{c} must be from 0 to 100") for c in ("x", "y")],
        (F.coalesce(F.size("evidence_ids"), F.lit(-1)) < 1, "evidence_ids must not be empty"), (F.col("company_cases").isNull(), "company_cases must be a list"),
    ]
    rank = F.col("matrix_rank")
    if ranked:
        rules += [(F.col("matrix_eligible").isNull(), "matrix_eligible must be true or false"), (rank.isNotNull() & ~rank.between(1, 12), "matrix_rank must be from 1 to 12"), (rank.isNotNull() & ~F.coalesce("matrix_eligible", F.lit(False)), "matrix_rank needs matrix_eligible")]
    if extended:
        rules += [
            (rank.isNotNull() & ((p == "P3") | red), "matrix_rank excludes P3 and red lines"), (~F.coalesce(F.col("confidence.level").isin(LEVELS), F.lit(False)) | _blank("confidence.reason"), "confidence needs a level and a reason"),
            (_blank("human_handoff"), "human_handoff must be text"), (~F.coalesce(F.col("evidence_window").isin(WINDOWS), F.lit(False)), "evidence_window is unknown"), *_texts("acceptance_metrics", 3),
            (F.coalesce(F.size("source_facts"), F.lit(-1)) < 1, "source_facts must not be empty"),
        ]
    return _broken(scenarios, F.format_string("scenarios[%d]", "i"), rules)


def reference_errors(scenarios: DataFrame, sources: DataFrame, extended: bool = True) -> DataFrame:
    """Rules between scenarios and sources: evidence, facts and cases name known ones; facts are in evidence; first priority has two publishers."""
    known = sources.select("library", "source_id", "publisher").distinct().hint("merge")
    place = F.format_string("scenarios[%d]", "i")
    used = scenarios.select("library", place.alias("place"), "priority", F.explode("evidence_ids").alias("source_id"))
    unknown = lambda rows, what: rows.join(known, ["library", "source_id"], "left_anti").select("library", "place", F.concat(F.lit(f"{what} names an unknown source "), "source_id").alias("error"))
    each = lambda col: scenarios.select("library", "i", "evidence_ids", F.posexplode(col).alias("k", "x")).withColumn("place", F.format_string(f"scenarios[%d].{col}[%d]", "i", "k")).select("library", "place", "evidence_ids", "x.*")
    cases = each("company_cases")
    out = unknown(used, "evidence_ids").unionByName(unknown(cases.where(~_blank("source_id")), "source_id"))
    rules = [(_blank(c), f"{c} must be text") for c in ("company", "summary", "source_id", "case_type", "caveat", "market")]
    rules += [(~F.coalesce(F.col("case_type").isin(CASE_TYPES), F.lit(False)), "case_type is unknown"), (~F.coalesce(F.col("market").isin(MARKETS), F.lit(False)), "market is unknown")]
    out = out.unionByName(_broken(cases, F.col("place"), rules))
    if extended:
        facts = each("source_facts")
        rules = [(_blank(c), f"{c} must be text") for c in ("source_id", "text", "locator")]
        rules.append((~_blank("source_id") & ~F.array_contains("evidence_ids", F.col("source_id")), "source_id must be among evidence_ids"))
        out = out.unionByName(unknown(facts.where(~_blank("source_id")), "source_id")).unionByName(_broken(facts, F.col("place"), rules))
        houses = used.where("priority = 'P0'").join(known, ["library", "source_id"], "left").groupBy("library", "place").agg(F.count_distinct(F.when(~_blank("publisher"), F.col("publisher"))).alias("n"))
        out = out.unionByName(houses.where("n < 2").select("library", "place", F.lit("P0 needs evidence of two publishers").alias("error")))
    return out


def library_errors(libraries: DataFrame, scenarios: DataFrame, pilot_rows: DataFrame, sources: DataFrame, extended: bool = True) -> DataFrame:
    """Rules on whole libraries (library, title, eyebrow, updated_at, core_judgment, scenario_count, p0_count), their pilots and sources."""
    s = scenarios.groupBy("library").agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "P0").alias("p0"), F.count_distinct("id").alias("ids"), F.sort_array(F.collect_list("matrix_rank")).alias("ranks"))
    homes = scenarios.select("library", F.explode("company_cases").alias("c")).where(F.col("c.market") == MARKET).groupBy("library").agg(F.count_distinct("c.company").alias("homes"))
    trials = pilot_rows.groupBy("library").agg(F.count("*").alias("pilots"))
    kept = sources.groupBy("library").agg(F.count("*").alias("sources"), F.count_distinct("source_id").alias("source_ids"))
    rows = libraries
    for other in (s, homes, trials, kept):
        rows = rows.join(other.hint("merge"), "library", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [(_blank(c), f"{c} must be text") for c in ("library", "title", "eyebrow", "updated_at", "core_judgment")]
    rules += [
        ((n("scenario_count") != n("n")) | ~n("n").between(20, 30), "scenario_count must be that of 20 to 30 scenarios"), (n("p0_count") != n("p0"), "p0_count must be the number of P0 scenarios"), (n("ids") != n("n"), "scenario ids must be unique"),
        (n("homes") < 2, "two companies of the home market are needed"), (n("pilots") > 3 if extended else n("pilots") != 3, "no more than 3 pilots" if extended else "exactly 3 pilots"), (n("sources") == 0, "sources must not be empty"), (n("source_ids") != n("sources"), "source ids must be unique"),
        (~F.coalesce(F.col("ranks").eqNullSafe(F.sequence(F.lit(1), F.lit(12))), F.lit(False)), "each matrix_rank from 1 to 12 once"),
    ]
    out = _broken(rows, F.lit("library"), rules)
    out = out.unionByName(_broken(pilot_rows, F.format_string("pilots[%d]", "i"), [(_blank(c), f"{c} must be text") for c in ("id", "label", "title", "scope", "acceptance")]))
    rules = [(_blank(c), f"{c} must be text") for c in ("source_id", "title", "publisher", "evidence_type", "limitation")]
    rules += [(~scores.source_url(F.col("url")), "url must be https or of the archive"), (F.col("published_at").isNotNull() & ~scores.strict_date(F.col("published_at")), "published_at must be a date")]
    return out.unionByName(_broken(sources, F.format_string("sources[%d]", "i"), rules))


def errors(libraries: DataFrame, scenarios: DataFrame, pilot_rows: DataFrame, sources: DataFrame, extended: bool = True) -> DataFrame:
    """All broken rules of libraries: (library, place, error)."""
    single = scenario_errors(scenarios, True, extended)
    return single.unionByName(reference_errors(scenarios, sources, extended)).unionByName(library_errors(libraries, scenarios, pilot_rows, sources, extended))


def shared_ids(libraries: DataFrame, scenarios: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids that occur more than once over all libraries: kind, id and count."""
    each = [("library", libraries, "library"), ("scenario", scenarios, "id"), ("source", sources, "source_id")]
    rows = reduce(DataFrame.unionByName, [r.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id")) for kind, r, c in each])
    return rows.groupBy("kind", "id").agg(F.count("*").alias("n")).where("n > 1")


def local_copies(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Archive sources (/archive/...) with what is wrong of their path: it leaves the archive, or no such file is listed (path)."""
    rows = sources.where(F.col("url").startswith("/archive/")).withColumn("path", F.url_decode(F.substring("url", 10, 100_000)))
    steps = F.filter(F.split("path", "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, p: F.struct((a.at + F.when(p == "..", -1).otherwise(1)).alias("at"), F.least(a.least, a.at + F.when(p == "..", -1).otherwise(1)).alias("least")))
    rows = rows.withColumn("out", depth.getField("least") < 0)
    listed = files.select("path", F.lit(True).alias("listed")).distinct()
    rows = rows.join(listed, "path", "left").withColumn("error", F.when(F.col("out"), "leaves the archive").when(F.col("listed").isNull(), "no such file"))
    return rows.where("error is not null").select("library", "source_id", "url", "error")


def archived(sources: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each source with where its copy comes from (library, source_id, local folder or null): local, remote, or missing from the mapping."""
    rows = sources.join(mappings.select("library", "source_id", "local", F.lit(True).alias("mapped")).hint("merge"), ["library", "source_id"], "left")
    return rows.withColumn("copy", F.when(F.col("mapped").isNull(), "missing").when(F.coalesce("local", F.lit("")) != "", "local").otherwise("remote")).drop("mapped")


def evidence_ledger(sources: DataFrame) -> DataFrame:
    return sources.select("library", "source_id", "title", "publisher", "published_at", "evidence_type", "url", "fact", "locator", "limitation")


def scenario_ledger(scenarios: DataFrame) -> DataFrame:
    cases = F.transform("company_cases", lambda c: F.struct(c.company.alias("company"), c.source_id.alias("source_id"), c.market.alias("market"), c.caveat.alias("caveat")))
    return scenarios.select("library", "id", "title", "priority", "matrix_eligible", "matrix_rank", "evidence_ids", "source_facts", cases.alias("company_cases"), "confidence", "evidence_window")


def write_ledgers(scenarios: DataFrame, sources: DataFrame, folder: str) -> None:
    """Both ledgers as lines of JSON, a folder a library."""
    for name, rows in (("evidence", evidence_ledger(sources)), ("scenarios", scenario_ledger(scenarios))):
        rows.select("library", F.to_json(F.struct(*[c for c in rows.columns if c != "library"])).alias("value")).write.mode("overwrite").partitionBy("library").text(f"{folder}/{name}")


def filtered(scenarios: DataFrame, priority: str = "all", category: str = "all") -> DataFrame:
    """Scenarios of a priority and a category; ``all`` matches all."""
    out = scenarios if priority == "all" else scenarios.where(F.col("priority") == priority)
    return out if category == "all" else out.where(F.col("category") == category)


def ordered(scenarios: DataFrame, mode: str = "number") -> DataFrame:
    """Places of scenarios in each library by number, by date (latest first, none last) or by score (then evidence, date and id)."""
    number = F.col("number").cast("int")
    orders = {"number": [number], "date": [F.desc_nulls_last("latest"), number], "score": [F.desc("total"), F.desc("evidence"), F.desc_nulls_last("latest"), F.asc("id")]}
    if mode not in orders:
        raise ValueError(f"unknown order {mode}")
    return scenarios.withColumn("place", F.row_number().over(Window.partitionBy("library").orderBy(*orders[mode])))
