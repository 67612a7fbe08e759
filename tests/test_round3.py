"""Faults of larger tables, each on a few rows."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from inkwell.operators import ledger, search
from inkwell.plans import editorial_queries, ledger_queries, library_queries, search_queries
from inkwell.streaming import runs


def test_word_ends_are_those_of_sql(spark):
    """A letter with a mark ends a word of the rules, as in the reference and in RE2."""
    texts = ["échré", "Aiaition échr", "hrs", "chr_x", "agenté x", "agents", "hr"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ledger.classify(F.col("t")).getField("primary").alias("c")).collect()
    con = duckdb.connect()
    want = {t: con.execute(f"SELECT {ledger_queries._class('t')} FROM (SELECT ? AS t)", [t]).fetchall()[0][0] for t in texts}
    assert {r.t: r.c for r in got} == want
    assert want["échré"] == "组织、人才与变革" and want["hrs"] == "AI战略与价值"


def test_refreshed_categories_end_words_as_sql(spark):
    """Records are classified by the same step: a title whose word ends before a marked letter."""
    columns = "candidate_id long, url string, publisher string, status string, reason string, published_at string, inspected_title string"
    candidates = spark.createDataFrame([(1, "https://a.example/x", "a.example", "included", None, None, "Chré éauxeau")], columns)
    overrides = spark.createDataFrame([], "url string, title_zh string, title_original string")
    existing = spark.createDataFrame([], "publisher string, archive_index int")
    row = ledger.refresh(candidates, overrides, existing).toArrow().to_pylist()[0]
    assert "组织、人才与变革" in row.values()


def test_facts_are_those_of_the_list(spark, tmp_path):
    """An opening line with a number and a unit adds none to the list's facts."""
    rows = [(i, 'the token = "373e80f4"', "en", "s1", 1) for i in range(3)] + [(3, "4486733645976649 wh of", "en", "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    got = editorial_queries.QUERIES["numeric_facts"](spark, str(tmp_path)).toArrow().to_pylist()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(editorial_queries.ORACLES["numeric_facts"]).fetchall()
    assert sorted((r["id"], r["number"], r["qualifier"]) for r in got) == sorted(want)


@pytest.mark.parametrize("seed", range(2))
def test_a_batch_of_queries_loses_no_answer(spark, seed):
    """Each task passes on its own best rows only: with ties, copies, null groups and groups over all tasks the answer is that of single searches."""
    dice = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    rows = [(f"d{i:03d}", dice.choice(["a", "b", "c", "d", "e", None]), " ".join(dice.choices(words, k=dice.randint(0, 6))) or None) for i in range(300)]
    docs = spark.createDataFrame(rows, "id string, publisher string, search_text string").repartition(7)
    asked = [(i, " ".join(dice.choices([*words, "unknown"], k=k))) for i, k in enumerate([1, 2, 3, 4, 5, 0])]
    got = search.search_many(docs, spark.createDataFrame(asked, "query_id int, query string")).toArrow().to_pylist()
    full = docs.selectExpr("*", *[f"cast(null as string) as {c}" for c in ("category", "priority", "published_at")])
    want = [(q, r.id, r.publisher, r.score, r.matched, r.rank) for q, t in asked if t for r in search.search(full, t.split()).collect()]
    assert sorted((r["query_id"], r["id"], r["publisher"], r["score"], r["matched"], r["rank"]) for r in got if r["rank"]) == sorted(want)
    assert search.search_many(docs.limit(0), spark.createDataFrame(asked, "query_id int, query string")).count() == 0
    assert search.search_many(docs, spark.createDataFrame(asked, "query_id int, query string").limit(0)).count() == 0


def test_no_score_of_a_batch_is_shuffled(spark):
    """What is shuffled of a batch of queries is what each task passes on, not a row a posting."""
    plan = search_queries.QUERIES["bm25_batch_queries"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "token" not in plan


def _plan(name, spark):
    return library_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_sources_of_libraries_are_not_broadcast(spark):
    """Forty sources a library grow with the libraries; their size is hidden from the planner."""
    for name in ("library_errors", "library_build", "library_by_date", "library_shared_ids", "library_pilots", "library_by_number", "library_filter"):
        assert "BroadcastExchange" not in _plan(name, spark), name
    assert _plan("library_errors", spark).count("Window") <= 8  # built once, not once a rule


@pytest.mark.parametrize("name", ["library_by_date", "library_build", "library_shared_ids", "library_pilots", "library_by_number", "library_filter"])
def test_a_library_run_broadcasts_nothing(spark, name):
    """Small rows tempt the planner to broadcast while it runs: the plan that ran is read, not the first one."""
    rows = library_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert rows.collect()
    ran = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in ran and "Broadcast" not in ran


def test_counting_keeps_a_task_for_each_part_of_the_state(spark, tmp_path):
    """One task for all parts holds the memory of all of them at once."""
    spark.sql("select timestamp'2026-01-01 10:00:00' as ts, 'a' as event_type from range(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = runs.keep_complete(runs.status_stream(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(i) for job in tracker.getJobIdsForGroup(str(query.runId)) for i in tracker.getJobInfo(job).stageIds]
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) in [s.numTasks for s in stages if s]
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [20]


def test_postings_are_counted_before_they_are_shuffled(spark):
    """A row a document and group of buckets is shuffled, not a row a posting or occurrence."""
    rows = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", [])], "id string, toks array<string>")
    got = search.counted(rows, ["id"], whole=True)
    assert sorted((r.id, r.token, r.tf) for r in got.collect()) == [("a", "", 1), ("a", "x", 2), ("a", "y", 1), ("b", "", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ") and "Aggregate" not in plan
