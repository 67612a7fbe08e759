"""Queries of the training-data operators against their SQL."""

import duckdb
import pytest
from cases import ROOT

from inkwell.llm.queries import ORACLES, QUERIES, REPORT_ORACLES, REPORTS


@pytest.mark.parametrize("name", sorted({**ORACLES, **REPORT_ORACLES}))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{ROOT}/documents.parquet'")
    want = con.sql({**ORACLES, **REPORT_ORACLES}[name]).to_arrow_table()
    got = {**QUERIES, **REPORTS}[name](spark, ROOT).toArrow()
    assert sorted(got.column_names) == sorted(want.column_names)
    plain = lambda t: sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in sorted(t.column_names)]) for r in t.to_pylist())
    assert plain(got) == plain(want)


def test_reports_have_oracles():
    assert set(REPORT_ORACLES) <= set(REPORTS)
