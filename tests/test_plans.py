"""Physical plans that must stay as they are."""

import re

from inkwell.functions import text
from inkwell.operators import archive, search
from inkwell.plans import bindings, registry

ROOT = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_index_reads_its_tokens_only(spark, tmp_path):
    search.write_index(bindings.searchable(bindings.ledger(spark, ROOT)), f"file://{tmp_path}")
    found = plan(search.search_index(spark, f"file://{tmp_path}", ["the", "reading"]))
    assert re.search(r"PartitionFilters: \[[^]]*bucket", found)
    assert re.search(r"PushedFilters: \[[^]]*In\(token", found)


def test_search_cuts_each_text_once_a_pass(spark):
    found = plan(registry.QUERIES["bm25_search_topk"](spark, ROOT))
    scans = found.count("FileScan parquet")
    assert found.count("regexp_extract_all(lower(") <= 2 * scans


def test_chunks_and_queues_are_map_only(spark):
    for name in ("chunk_corpus", "queue_entries", "canonical_urls", "translation_verify"):
        assert "Exchange" not in plan(registry.QUERIES[name](spark, ROOT)), name


def test_the_entry_loads_without_a_session():
    import subprocess
    import sys

    import __spark_entry__ as entry

    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    root = entry.__file__.rsplit("/", 1)[0]
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


def test_the_checked_queue_is_one_pass(spark):
    """No text goes through a join, none is checked twice, and no array holds a text's characters."""
    found = plan(registry.QUERIES["queue_checked"](spark, ROOT))
    assert "Exchange" not in found and found.count("MapInArrow") == 1
    assert not re.search(r"regexp_extract_all\(coalesce\([a-z]+#\d+, \), \[(A-Za-z\]|\\p|\\x)", found)
    rows = [(1, "Ü é1", "中文𠀀ab"), (2, None, " "), (3, "x", None), (None, "h", "题")]
    got = archive.queue_checked(spark.createDataFrame([(*r, "p", 1) for r in rows], "id int, source string, translation string, publisher string, archive_index int"))
    assert {r.id: (r.status, r.source_language, r.source_characters) for r in got.collect()} == {1: ("invalid", "en", 4), 2: ("pending", "en", 0), 3: ("pending", "en", 1), None: ("complete", "en", 1)}
    t = spark.createDataFrame([("中文𠀀ab1",)], "t string")
    assert t.select(text.han_ratio(t.t)).first()[0] == 0.5
