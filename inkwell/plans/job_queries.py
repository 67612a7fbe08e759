"""The jobs as queries: each run twice on whole tables, and what is written then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell.plans.document_queries import _CHUNKS
from inkwell.scratch import shared_dir
from jobs import collect_evidence, refresh_corpus


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "refresh")
    for _ in range(2):
        refresh_corpus.refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/corpus", f"{folder}/checkpoint")
    return refresh_corpus.current(spark, f"{folder}/corpus")


def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "evidence")
    for _ in range(2):
        collect_evidence.collect(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", folder)
    return collect_evidence.evidence(spark, folder)


QUERIES = {"job1_refresh_corpus": refreshed, "job2_collect_evidence": collected}

_ID = "id::VARCHAR || ':' || lpad(chunk_no::VARCHAR, greatest(3, length(chunk_no::VARCHAR))::INT, '0')"
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9][a-z0-9+._-]*')"

ORACLES = {
    "job1_refresh_corpus": f"""WITH RECURSIVE {_CHUNKS}, first AS (SELECT min(doc_id) AS id FROM documents GROUP BY text)
        SELECT id, source AS publisher, lang, chunk_no, section_path, content, {_ID} AS chunk_id, sha256(content) AS fingerprint
        FROM chunks JOIN first USING (id) JOIN documents ON doc_id = id""",
    "job2_collect_evidence": f"""WITH RECURSIVE {_CHUNKS},
        toks AS (SELECT {_ID} AS chunk_id, id AS article_id, content, section_path, list_concat({_TOKENS.format('content')}, ['正文']) AS t FROM chunks),
        stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
        asked AS (SELECT item_id AS question_id, list_distinct({_TOKENS.format('text')}) AS q FROM benchmark),
        terms AS (SELECT question_id, len(q) AS n_query, unnest(q) AS token FROM asked),
        tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS token FROM toks) WHERE token IN (SELECT token FROM terms) GROUP BY ALL),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        scored AS (SELECT question_id, n_query, chunk_id, article_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / greatest(average, 1)))), 6) AS score, count(*)::INT AS matched
                   FROM toks JOIN tf USING (chunk_id) JOIN df USING (token) JOIN terms USING (token), stats GROUP BY ALL),
        capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY question_id, article_id ORDER BY score DESC, chunk_id) <= 3),
        best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM capped QUALIFY rank <= 12),
        found AS (SELECT * FROM best QUALIFY bool_or(matched >= CASE WHEN n_query >= 4 THEN 2 ELSE 1 END AND score >= 0.25) OVER (PARTITION BY question_id)),
        counts AS (SELECT question_id, count(*) AS n_evidence, count(DISTINCT article_id) AS n_articles FROM found GROUP BY question_id)
        SELECT question_id, len(q)::INT AS n_tokens, coalesce(n_evidence, 0)::BIGINT AS n_evidence, coalesce(n_articles, 0)::BIGINT AS n_articles, n_evidence IS NULL AS insufficient,
               chunk_id, article_id, score, matched, rank, section_path, substr(content, 1, 220) AS summary, source AS publisher
        FROM asked LEFT JOIN counts USING (question_id) LEFT JOIN found USING (question_id) LEFT JOIN toks USING (chunk_id, article_id) LEFT JOIN documents ON doc_id = found.article_id""",
}
