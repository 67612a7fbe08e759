"""Named queries over the test tables, each with its independent SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _load() -> None:
    from inkwell.plans import adapter_queries, document_queries, editorial_queries, extra_queries, intake_queries, job_queries, keeping_queries, ledger_queries, library_queries, search_queries, stream_queries

    for module in (search_queries, ledger_queries, document_queries, editorial_queries, stream_queries, extra_queries, intake_queries, library_queries, keeping_queries, adapter_queries, job_queries):
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)


_load()
