"""What a Python worker holds at once doesn't grow with its batch."""

import pyarrow as pa
import pytest

from inkwell.operators import chunks, editorial


@pytest.fixture
def function(spark, monkeypatch):
    """The function that an operator hands to mapInArrow, and a table."""
    docs = spark.createDataFrame([(1, "a")], "id long, text string")
    found = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: found.append(run) or self.withColumns({"chunk_no": self[self.columns[0]], "content": self[self.columns[0]].cast("string")}))
    return docs, found


def passed(run, n=1000):
    out = [b for b in run(iter([pa.RecordBatch.from_pydict({"id": [*range(n)], "text": ["# t\n\nx"] * n})]))]
    assert [i for b in out for i in b.column(0).to_pylist()] == [*range(n)]
    return max(b.num_rows for b in out)


def test_sections_leave_a_worker_in_slices(function):
    docs, found = function
    chunks.chunk(docs, "id", "text", 1_000_000)
    assert passed(found[0]) <= 100
    assert int(docs.sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_chunks_leave_a_worker_in_slices(function):
    docs, found = function
    chunks.chunk(docs, "id", "text")
    assert passed(found[0]) <= 100


def test_reader_pages_leave_a_worker_in_slices(function):
    docs, found = function
    editorial.rows_of(docs, ["text"], lambda t: [(t,)], {"html": "string"})
    assert passed(found[0]) <= 100
