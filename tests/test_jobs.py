"""The jobs over growing input, run again, and from their command lines."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest

from inkwell.operators import chunks
from inkwell.plans import job_queries
from jobs import collect_evidence, refresh_corpus

REPO = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("part-*"))


def passages(spark, corpus):
    return sorted((r.id, r.chunk_no, r.content, r.publisher) for r in refresh_corpus.current(spark, str(corpus)).collect())


def cut(rows):
    """What the corpus must hold of articles (id, text, publisher)."""
    return sorted((i, n, content, publisher) for i, text, publisher in rows for n, _, content in chunks.chunked(text))


LONG = "A sentence of some words. " * 200


def test_only_what_is_new_is_taken(spark, tmp_path):
    docs, corpus, checkpoint = tmp_path / "documents", tmp_path / "corpus", tmp_path / "checkpoint"
    run = lambda: refresh_corpus.refresh(spark, str(docs), str(corpus), str(checkpoint))
    logged = lambda n: json.loads("".join(p.read_text() for p in (corpus / f"log/batch={n}").glob("part-*")))
    add(spark, docs, [(1, LONG, "en", "s1", 1), (2, "two", "fr", None, 1), (3, "three", "en", "", 1), (4, None, None, "s2", 1), (5, "  ", "en", "s2", 1), (None, "lost", "en", "s1", 1)])
    run()
    first = cut([(1, LONG, "s1"), (2, "two", None), (3, "three", "")])
    assert passages(spark, corpus) == first
    assert logged(0) == {"rows_read": 6, "without_id": 1, "repeated": 0, "unchanged": 0, "new": 5, "changed": 0, "passages": len(first)}
    before = files(corpus)
    run()  # nothing new
    assert files(corpus) == before

    # A copy under a smaller id, a changed text, the same row again, two texts of one id, and a new article.
    add(spark, docs, [(0, LONG, "en", "s9", 1), (2, "two, changed", "fr", "s3", 1), (3, "three", "en", "", 1), (7, "a", "en", "s1", 1), (7, "b", "en", "s1", 1), (8, "# H\n\neight", "en", "s1", 1), (8, "# H\n\neight", "en", "s1", 1)])
    run()
    got = passages(spark, corpus)
    seven = [r for r in got if r[0] == 7]
    assert len(seven) == 1 and seven[0][2] in "ab"
    assert got == sorted(cut([(0, LONG, "s9"), (2, "two, changed", "s3"), (3, "three", ""), (8, "# H\n\neight", "s1")]) + seven)
    counts = logged(1)
    assert counts == {"rows_read": 7, "without_id": 0, "repeated": 2, "unchanged": 1, "new": 3, "changed": 1, "passages": counts["passages"]}
    assert set(before) <= set(files(corpus))  # files of the first batch stay as they are

    # A run that died before the stream noted the batch: it is run again and comes out the same.
    (checkpoint / "commits/1").unlink()
    for crc in (checkpoint / "commits").glob(".1*"):
        crc.unlink()
    run()
    assert passages(spark, corpus) == got and logged(1) == counts
    assert len(files(corpus / "articles/batch=0")) == len([f for f in before if f.startswith("articles/batch=0")])


def test_growth_equals_one_run_over_all(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    for name, cuts in (("whole", [200]), ("grown", [70, 71, 200])):
        start = 0
        for end in cuts:
            add(spark, tmp_path / f"{name}-docs", table[start:end])
            start = end
            refresh_corpus.refresh(spark, str(tmp_path / f"{name}-docs"), str(tmp_path / name), str(tmp_path / f"{name}-mark"), files_per_batch=2)
    assert passages(spark, tmp_path / "grown") == passages(spark, tmp_path / "whole")
    assert len(list((tmp_path / "grown/articles").glob("batch=*"))) == 3


def test_large_shelves_are_split(spark, tmp_path):
    """One publisher may hold most rows: the write is dealt by size, not by name alone."""
    held = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        add(spark, tmp_path / "docs", [(i, f"{os.urandom(2000).hex()}", "en", "hot", 1) for i in range(3000)])
        refresh_corpus.refresh(spark, str(tmp_path / "docs"), str(tmp_path / "corpus"), str(tmp_path / "mark"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", held)
    assert len(files(tmp_path / "corpus/passages/batch=0/shelf=hot")) > 1


def test_evidence_is_replaced_as_a_whole(spark, tmp_path):
    docs, questions, out = tmp_path / "docs", tmp_path / "questions", tmp_path / "out"
    add(spark, docs, [(1, "alpha beta gamma delta", "en", "s1", 1), (2, "alpha beta", "en", None, 1), (3, None, "en", "s1", 1), (4, "epsilon", "fr", "unknown", 1)])
    spark.createDataFrame([(1, "alpha gamma"), (2, "nothing like it"), (3, None), (4, "epsilon")], "item_id long, text string").write.parquet(str(questions))
    held = {name: spark.conf.get(name) for name in collect_evidence.CHANGED}
    seen = []
    for _ in range(2):
        collect_evidence.collect(spark, str(docs), str(questions), str(out))
        seen.append(sorted(map(str, collect_evidence.evidence(spark, str(out)).collect())))
    assert seen[0] == seen[1]
    assert held == {name: spark.conf.get(name) for name in collect_evidence.CHANGED}
    got = collect_evidence.evidence(spark, str(out)).orderBy("question_id", "rank").collect()
    assert [(r.question_id, r.article_id, r.rank, r.publisher, r.insufficient) for r in got] == [(1, 1, 1, "s1", False), (1, 2, 2, None, False), (2, None, None, None, True), (3, None, None, None, True), (4, 4, 1, "unknown", False)]
    collect_evidence.collect(spark, str(docs), str(questions), str(out), languages=["fr"])
    assert {r.article_id for r in collect_evidence.evidence(spark, str(out)).collect()} == {None, 4}


def test_queries_leave_no_settings(spark):
    held = spark.sparkContext.getConf().getAll(), {k: spark.conf.get(k, None) for k in (*collect_evidence.CHANGED, "spark.sql.adaptive.enabled")}
    assert set(job_queries.ORACLES) == set(job_queries.QUERIES)
    job_queries.collected(spark, "/root/testdata/sf0.001").count()
    job_queries.refreshed(spark, "/root/testdata/sf0.001").count()
    assert held == (spark.sparkContext.getConf().getAll(), {k: spark.conf.get(k, None) for k in held[1]})


@pytest.mark.parametrize("name,paths,made", [("refresh_corpus", ("documents", "corpus", "checkpoint"), "corpus/articles/batch=0"), ("collect_evidence", ("documents", "questions", "path"), "path/evidence")])
def test_command_line(tmp_path, name, paths, made):
    given = [x for p in paths for x in (f"--{p}", {"documents": "/root/testdata/sf0.001/documents.parquet", "questions": "/root/testdata/sf0.001/benchmark.parquet"}.get(p, str(tmp_path / p)))]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[4] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=4 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *given, "--set", "overlap=100"], cwd=REPO, env=env, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert name in done.stderr and "/root/testdata/sf0.001/documents.parquet" in done.stderr
    assert files(tmp_path / made)
