"""Physical plans that must stay as they are."""

import re

from cases import ROOT

from inkwell.llm import decontaminate, language, mixing, quality
from inkwell.llm.queries import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_the_mix_runs_no_python(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    for frame in (mixing.mix(docs), mixing.mixed(docs)):
        assert not re.search("Python|Pandas|Arrow", plan(frame))


def test_map_only_operators_do_not_shuffle(spark):
    docs, items = spark.read.parquet(f"{ROOT}/documents.parquet"), spark.read.parquet(f"{ROOT}/benchmark.parquet")
    for frame in (quality.ledger(docs), language.identify(docs, language.train(docs)), decontaminate.find(docs, items), decontaminate.clean(docs, items)):
        assert "Exchange" not in plan(frame)


def test_scans_read_only_what_they_need(spark):
    assert "lang" not in re.search(r"ReadSchema: (\S+)", plan(QUERIES["op7_quality_rules"](spark, ROOT)))[1]
