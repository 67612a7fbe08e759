"""Cited answers: referential checks, sources in order of first use, and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("sources", "insufficient", "error", "done")


def citations(claims: DataFrame) -> DataFrame:
    """(answer_id, claim, position, citation) of every claim (answer_id, claim, text, kind, cited)."""
    return claims.select("answer_id", "claim", F.posexplode("cited").alias("position", "citation"))


def claim_violations(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per broken rule: empty text, unknown kind, no citation, repeated citation, unknown citation."""
    rules = {
        "empty text": F.trim(F.coalesce("text", F.lit(""))) == "",
        "unknown kind": ~F.coalesce(F.col("kind").isin("source_fact", "analysis"), F.lit(False)),
        "no citation": F.size(F.coalesce("cited", F.array().cast("array<string>"))) == 0,
        "repeated citation": F.size(F.array_distinct("cited")) != F.size("cited"),
    }
    own = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    first = claims.select("answer_id", "claim", F.explode(own).alias("violation"))
    unknown = citations(claims).join(evidence.select(F.col("chunk_id").alias("citation")), "citation", "left_anti").select("answer_id", "claim", F.concat(F.lit("unknown citation: "), "citation").alias("violation")).distinct()
    return first.unionByName(unknown)


def sources(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """The cited chunks of each answer, in the order in which they are first cited."""
    used = citations(claims).groupBy("answer_id", "citation").agg(F.min(F.struct("claim", "position")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("answer_id").orderBy("first"))
    return used.join(evidence.withColumnRenamed("chunk_id", "citation"), "citation").withColumn("rank", rank).drop("first")


def answer_violations(answers: DataFrame) -> DataFrame:
    """Rules on whole answers (answer_id, answer, insufficient, sections, n_claims); sections have heading, body, items."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    sections = F.coalesce("sections", F.array().cast("array<struct<heading:string,body:string,items:array<string>>>"))
    rules = {
        "empty answer": ~some(F.col("answer")),
        "insufficient is missing": F.col("insufficient").isNull(),
        "2 to 4 sections": ~(F.col("insufficient") & F.col("sections").isNull()) & ~F.size(sections).between(2, 4),
        "empty heading": F.exists(sections, lambda s: ~some(s.heading)),
        "one of body or items": F.exists(sections, lambda s: s.body.isNull() == s["items"].isNull()),
        "empty items": F.exists(sections, lambda s: s["items"].isNotNull() & ((F.size(s["items"]) == 0) | F.exists(s["items"], lambda i: ~some(i)))),
        "claims without evidence": F.col("insufficient") & (F.col("n_claims") > 0),
    }
    found = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))
    return answers.select("answer_id", F.explode(found).alias("violation"))


def events(answers: DataFrame) -> DataFrame:
    """The ordered events of each answer (answer_id, insufficient, failed, n_sections)."""
    one = lambda kind, stage=None: F.struct(F.lit(kind).alias("type"), F.lit(stage).cast("string").alias("stage"))
    head = F.array(one("status", "retrieving"))
    weak = F.array(one("insufficient"), one("done"))
    broken = F.array(one("status", "generating"), one("error"), one("done"))
    body = F.transform(F.sequence(F.lit(1), F.greatest("n_sections", F.lit(1))), lambda _: one("section"))
    full = F.concat(F.array(one("status", "generating"), one("status", "validating"), one("answer_start")), F.when(F.col("n_sections") > 0, body).otherwise(F.array().cast("array<struct<type:string,stage:string>>")), F.array(one("sources"), one("done")))
    rows = F.concat(head, F.when(F.col("insufficient"), weak).when(F.col("failed"), broken).otherwise(full))
    return answers.select("answer_id", F.posexplode(rows).alias("seq", "event")).select("answer_id", "seq", "event.type", "event.stage")


def outcome(stream: DataFrame) -> DataFrame:
    """How each stream of events (answer_id, seq, type) ended for its reader; one that stops early failed."""
    final = stream.where(F.col("type").isin(*TERMINAL)).groupBy("answer_id").agg(F.min_by("type", "seq").alias("ended"))
    return stream.select("answer_id").distinct().join(final, "answer_id", "left").select("answer_id", F.coalesce("ended", F.lit("interrupted")).alias("ended"))
