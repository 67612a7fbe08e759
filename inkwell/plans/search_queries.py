"""Tokens, statistics and BM25 search."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import text
from inkwell.operators import answers, search, segments
from inkwell.plans import bindings as b
from inkwell.plans.document_queries import _CHUNKS
from inkwell.scratch import Scratch

QUERY = ["the", "reading", "tion", "and", "er"]
FILTERS = {"publishers": ["src1", "src3", "src5"], "priorities": ["must-read", "track"], "date_from": "2026-02-01", "date_to": "2026-06-30"}
HAN = ["企业 AI 治理 strategy-value", "人", "供应链韧性 and cost", "", "Ｃ全角 mixed 中a文", "数据。平台"]


def _han(spark):
    return spark.createDataFrame(list(enumerate(HAN)), "id int, text string")


def _projection(spark, sf):
    top = search.search(b.searchable(b.ledger(spark, sf)), QUERY)
    return top.join(b.ledger(spark, sf).select("id", "title", "published_at", "url", F.substring("content", 1, 220).alias("summary")), "id")


def _indexed(spark, sf, filters=None):
    path = Scratch(spark, "index").path
    search.write_index(b.searchable(b.ledger(spark, sf)), path)
    return search.search_index(spark, path, QUERY, filters)


def _kept_up(spark, sf, filters=None, merge=False):
    """An index that starts without a fifth of the documents, with old texts of a seventh and some strangers, and is then brought to the ledger."""
    path, i = Scratch(spark, "segments").path, F.col("doc_id")
    rows = b.searchable(b.ledger(spark, sf)).select("id", "doc_id", "publisher", "category", "priority", "published_at", "search_text")
    old = rows.where(i % 5 != 0).withColumn("search_text", F.when(i % 7 == 3, F.concat(F.lit("the old reading of "), F.reverse("search_text"))).otherwise(F.col("search_text")))
    strangers = rows.where(i % 11 == 0).withColumn("id", F.concat(F.lit("old-"), "id"))
    none = rows.select("id").limit(0)
    segments.create(old.union(strangers), path)
    segments.update(rows.where((i % 5 == 0) | (i % 7 == 3)), none, path, 1)
    segments.update(rows.limit(0), strangers.select("id"), path, 2)
    if merge:
        segments.merged(spark, path, f"{path}-merged")
    return segments.find(spark, f"{path}-merged" if merge else path, QUERY, filters)


def _batch(spark, sf):
    asked = b.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.search_many(b.searchable(b.ledger(spark, sf)), asked)


_BM25 = """{ledger}, {toks},
stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM toks) WHERE token IN ({terms}) GROUP BY id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scored AS (
    SELECT id, publisher, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / greatest(average, 1)))), 6) AS score, count(*) AS matched
    FROM toks JOIN tf USING (id) JOIN df USING (token), stats WHERE {where} GROUP BY id, publisher),
capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY score DESC, id) <= 3),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM capped QUALIFY rank <= 12),
result AS (SELECT * FROM best WHERE (SELECT bool_or(matched >= {least} AND score >= 0.25) FROM best))"""


def _bm25(terms, where="TRUE", then="SELECT id, publisher, score, matched::INT AS matched, rank FROM result"):
    listed = ", ".join(f"'{t}'" for t in terms)
    return "WITH " + _BM25.format(ledger=b.LEDGER, toks=b.SEARCHABLE, terms=listed, where=where, least=2 if len(terms) >= 4 else 1) + " " + then


def _chunked(spark, sf):
    """The ledger's articles, some with a core view and evidence, as chunks; ids of unequal widths."""
    i = F.col("doc_id")
    rows = b.ledger(spark, sf).withColumn("id", i.cast("string")).withColumn("core_view", F.when(i % 3 == 0, F.col("title"))).withColumn("evidence", F.when(i % 5 == 0, "reading of the tion"))
    return search.chunk_rows(rows)


_CHUNK_BM25 = f"""WITH RECURSIVE {b.LEDGER}, {_CHUNKS},
rows_ AS (SELECT id::VARCHAR || ':' || lpad(chunk_no::VARCHAR, greatest(3, length(chunk_no::VARCHAR))::INT, '0') AS chunk_id, id::VARCHAR AS article_id, publisher, priority, published_at,
    list_concat(regexp_extract_all(lower(repeat(coalesce(title, '') || ' ', 3) || CASE WHEN id % 3 = 0 THEN repeat(coalesce(title, '') || ' ', 2) ELSE '' END || CASE WHEN id % 5 = 0 THEN repeat('reading of the tion ', 2) ELSE '' END || c.content), '[a-z0-9][a-z0-9+._-]*'), ['正文']) AS t
    FROM chunks c JOIN (SELECT doc_id, title, publisher, priority, published_at FROM ledger) l ON l.doc_id = c.id),
stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM rows_),
tf AS (SELECT chunk_id, token, count(*) AS tf FROM (SELECT chunk_id, unnest(t) AS token FROM rows_) WHERE token IN ({{terms}}) GROUP BY chunk_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
scored AS (SELECT chunk_id, article_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / greatest(average, 1)))), 6) AS score, count(*)::INT AS matched
    FROM rows_ JOIN tf USING (chunk_id) JOIN df USING (token), stats WHERE {{where}} GROUP BY chunk_id, article_id),
capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_id COLLATE en) <= 3),
best AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id COLLATE en)::INT AS rank FROM capped QUALIFY rank <= 12)
SELECT * FROM best WHERE (SELECT bool_or(matched >= {{least}} AND score >= 0.25) FROM best)"""


def _chunk_bm25(terms, where="TRUE"):
    return _CHUNK_BM25.format(terms=", ".join(f"'{t}'" for t in terms), where=where, least=2 if len(terms) >= 4 else 1)


_LATIN = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9+._-]*')"

QUERIES = {
    "bm25_search_topk": lambda s, sf: search.search(b.searchable(b.ledger(s, sf)), QUERY),
    "bm25_filtered": lambda s, sf: search.search(b.searchable(b.ledger(s, sf)), QUERY, FILTERS),
    "bm25_indexed": _indexed,
    "bm25_indexed_filtered": lambda s, sf: _indexed(s, sf, FILTERS),
    "bm25_index_kept_up": _kept_up,
    "bm25_index_merged": lambda s, sf: _kept_up(s, sf, FILTERS, merge=True),
    "bm25_insufficient": lambda s, sf: search.search(b.searchable(b.ledger(s, sf)), ["zzzz-unknown", "qqqq-unknown", "the.never", "no+such"]),
    "bm25_batch_queries": _batch,
    "chunk_search": lambda s, sf: search.search_chunks(_chunked(s, sf), QUERY),
    "chunk_search_filtered": lambda s, sf: search.search_chunks(_chunked(s, sf), ["the", "tion"], FILTERS),
    "evidence_projection": _projection,
    "tokenize_counts": lambda s, sf: b.table(s, sf, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(text.tokens(F.col("text")))).alias("n_distinct")),
    "tokenize_han_bigrams": lambda s, sf: _han(s).select("id", F.array_join(text.tokens(F.col("text")), "|").alias("tokens")),
    "term_freq": lambda s, sf: search.term_frequencies(b.table(s, sf, "documents"), "doc_id", "text"),
    "doc_freq": lambda s, sf: search.document_frequencies(b.table(s, sf, "documents"), "text"),
    "doc_stats": lambda s, sf: search.document_statistics(b.table(s, sf, "documents"), "text"),
}

_WHERE = "publisher IN ('src1', 'src3', 'src5') AND priority IN ('must-read', 'track') AND (published_at IS NULL OR published_at BETWEEN '2026-02-01' AND '2026-06-30T23:59:59')"
_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(HAN))

ORACLES = {
    "bm25_search_topk": _bm25(QUERY),
    "bm25_filtered": _bm25(QUERY, _WHERE),
    "chunk_search": _chunk_bm25(QUERY),
    "chunk_search_filtered": _chunk_bm25(["the", "tion"], _WHERE),
    "bm25_indexed": _bm25(QUERY),
    "bm25_indexed_filtered": _bm25(QUERY, _WHERE),
    "bm25_index_kept_up": _bm25(QUERY),
    "bm25_index_merged": _bm25(QUERY, _WHERE),
    "bm25_insufficient": _bm25(["zzzz-unknown", "qqqq-unknown", "the.never", "no+such"]),
    "bm25_batch_queries": f"""WITH {b.LEDGER}, {b.SEARCHABLE},
        stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
        asked AS (SELECT item_id AS query_id, list_distinct({_LATIN}) AS q FROM benchmark),
        terms AS (SELECT query_id, len(q) AS n_query, unnest(q) AS token FROM asked),
        tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM toks) WHERE token IN (SELECT token FROM terms) GROUP BY id, token),
        df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
        scored AS (SELECT query_id, n_query, id, publisher, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(t) / greatest(average, 1)))), 6) AS score, count(*) AS matched
                   FROM toks JOIN tf USING (id) JOIN df USING (token) JOIN terms USING (token), stats GROUP BY ALL),
        capped AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id, publisher ORDER BY score DESC, id) <= 3),
        best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM capped QUALIFY rank <= 12)
        SELECT query_id, n_query::INT AS n_query, id, publisher, score, matched, rank FROM best
        QUALIFY bool_or(matched >= CASE WHEN n_query >= 4 THEN 2 ELSE 1 END AND score >= 0.25) OVER (PARTITION BY query_id)""",
    "evidence_projection": _bm25(QUERY, then="SELECT id, r.publisher, score, matched::INT AS matched, rank, title, published_at, url, substr(content, 1, 220) AS summary FROM result r JOIN ledger USING (id)"),
    "tokenize_counts": f"SELECT doc_id, len({_LATIN})::INT AS n_tokens, len(list_distinct({_LATIN}))::INT AS n_distinct FROM documents",
    "tokenize_han_bigrams": f"""WITH v(id, text) AS (VALUES {_VALUES}), t AS (
        SELECT id, {_LATIN} AS latin, list_transform(regexp_extract_all(text, '\\p{{Han}}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)) END) AS han FROM v)
        SELECT id, array_to_string(list_concat(latin, coalesce(flatten(han), [])), '|') AS tokens FROM t""",
    "term_freq": f"SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({_LATIN}) AS token FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_LATIN}) AS token FROM documents) GROUP BY token",
    "doc_stats": f"SELECT count(*) AS n_docs, sum(len({_LATIN}))::BIGINT AS n_tokens, avg(len({_LATIN})) AS avg_length FROM documents",
}

CLAIMS = [
    (1, 1, "Costs fell", "source_fact", ["c2", "c1"]), (1, 2, "It will last", "analysis", ["c1", "c3"]), (2, 1, " ", "source_fact", ["c1"]), (2, 2, "x", "guess", ["c9", "c9"]),
    (3, 1, "y", "analysis", []), (4, 1, "z", "source_fact", ["c3", "c4"]),
]
CHUNKS = [("c1", "a1", "src1"), ("c2", "a1", "src1"), ("c3", "a2", "src2"), ("c4", "a3", None)]
SECTION = "array<struct<heading:string,body:string,items:array<string>>>"
ANSWERS = [
    (1, "ok", False, [("h", "b", None), ("h2", None, ["i"])], 2), (2, "", False, [("h", "b", ["i"])], 0), (3, "weak", True, None, 0), (4, "weak", True, None, 3),
    (5, "x", None, [("", "b", None), ("h", None, [])], 1), (6, "x", False, [("h", None, [" "]), ("h", None, None)], 1),
]


def _mixed(spark, sf):
    """documents with Han runs of several lengths between Latin words."""
    i = F.col("doc_id")
    return b.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("企业治理 "), "text", F.lit(" A中b"), F.repeat(F.lit("数"), (i % 4).cast("int")), F.lit("。据")).alias("text"))


def _cited_turns(spark, sf):
    """conversations as cited answers, a claim a turn, with faults by rule; the evidence is a chunk a document."""
    c, n = F.col("conv_id"), F.col("turn")
    chunk = lambda k: F.concat(F.lit("c"), k)
    cited = F.when((c + n) % 11 == 0, F.array().cast("array<string>")).when((c + n) % 7 == 0, F.array(chunk(c), chunk(c))).otherwise(F.array(chunk(c + n), chunk(c * 7)))
    claims = b.table(spark, sf, "conversations").select(c.alias("answer_id"), n.cast("int").alias("claim"), F.when((c + n) % 13 != 0, F.col("text")).otherwise(" ").alias("text"), F.when(n % 5 == 4, "guess").otherwise("analysis").alias("kind"), cited.alias("cited"))
    evidence = b.table(spark, sf, "documents").select(chunk(F.col("doc_id")).alias("chunk_id"), F.concat(F.lit("a"), F.col("doc_id") % 10).alias("article_id"), F.col("source").alias("publisher"))
    return claims, evidence


_TURNS = """c AS (SELECT conv_id AS answer_id, turn::INT AS claim, CASE WHEN (conv_id + turn) % 13 <> 0 THEN text ELSE ' ' END AS text, CASE WHEN turn % 5 = 4 THEN 'guess' ELSE 'analysis' END AS kind,
    CASE WHEN (conv_id + turn) % 11 = 0 THEN []::VARCHAR[] WHEN (conv_id + turn) % 7 = 0 THEN ['c' || conv_id, 'c' || conv_id] ELSE ['c' || (conv_id + turn), 'c' || (conv_id * 7)] END AS cited FROM conversations),
    k AS (SELECT 'c' || doc_id AS chunk_id, 'a' || doc_id % 10 AS article_id, source AS publisher FROM documents)"""
_CLAIM_VALUES = ", ".join(f"({a}, {c}, '{t}', '{k}', {cited}::VARCHAR[])" for a, c, t, k, cited in CLAIMS)
_CHUNK_VALUES = ", ".join(f"('{c}', '{a}', {repr(p) if p else 'NULL'})" for c, a, p in CHUNKS)


def _claims(spark):
    return spark.createDataFrame(CLAIMS, "answer_id int, claim int, text string, kind string, cited array<string>")


def _chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, article_id string, publisher string")


def _runs(spark, sf):
    """Conversations as answers: insufficient, failed and the number of sections by rule."""
    turns = b.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    return turns.select(F.col("conv_id").alias("answer_id"), (F.col("conv_id") % 5 == 0).alias("insufficient"), (F.col("conv_id") % 7 == 0).alias("failed"), (F.col("turns") % 5).cast("int").alias("n_sections"))


def _cut(stream):
    return stream.where(~((F.col("answer_id") % 6 == 0) & F.col("type").isin(*answers.TERMINAL)))


QUERIES |= {
    "tokenize_mixed": lambda s, sf: _mixed(s, sf).select("doc_id", F.size(text.tokens(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(text.tokens(F.col("text")), "|")).alias("tokens_md5")),
    "turn_citations": lambda s, sf: answers.claim_violations(*_cited_turns(s, sf)),
    "turn_sources": lambda s, sf: answers.sources(*_cited_turns(s, sf)),
    "citation_validate": lambda s, sf: answers.claim_violations(_claims(s), _chunks(s)),
    "answer_sources": lambda s, sf: answers.sources(_claims(s), _chunks(s)),
    "answer_violations": lambda s, sf: answers.answer_violations(s.createDataFrame(ANSWERS, f"answer_id int, answer string, insufficient boolean, sections {SECTION}, n_claims int")),
    "stream_events_order": lambda s, sf: answers.events(_runs(s, sf)),
    "stream_terminal_state": lambda s, sf: answers.outcome(_cut(answers.events(_runs(s, sf)))),
}
_RUNS = "runs AS (SELECT conv_id AS answer_id, conv_id % 5 = 0 AS insufficient, conv_id % 7 = 0 AS failed, (count(*) % 5)::INT AS n_sections FROM conversations GROUP BY conv_id)"
_EVENTS = """lists AS (SELECT answer_id, CASE WHEN insufficient THEN ['status:retrieving', 'insufficient:', 'done:'] WHEN failed THEN ['status:retrieving', 'status:generating', 'error:', 'done:']
          ELSE ['status:retrieving', 'status:generating', 'status:validating', 'answer_start:'] || list_transform(range(n_sections), lambda x: 'section:') || ['sources:', 'done:'] END AS e FROM runs),
     events2 AS (SELECT answer_id, (unnest(range(len(e))))::INT AS seq, unnest(e) AS v FROM lists),
     stream AS (SELECT answer_id, seq, string_split(v, ':')[1] AS type, nullif(string_split(v, ':')[2], '') AS stage FROM events2)"""
ORACLES |= {
    "tokenize_mixed": f"""WITH v AS (SELECT doc_id, '企业治理 ' || text || ' A中b' || repeat('数', (doc_id % 4)::INT) || '。据' AS text FROM documents), t AS (
        SELECT doc_id, {_LATIN} AS latin, list_transform(regexp_extract_all(text, '\\p{{Han}}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i::INT, 2)) END) AS han FROM v)
        SELECT doc_id, (len(latin) + len(flatten(han)))::INT AS n_tokens, md5(array_to_string(list_concat(latin, flatten(han)), '|')) AS tokens_md5 FROM t""",
    "turn_citations": f"""WITH {_TURNS} SELECT answer_id, claim, 'empty text' AS violation FROM c WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT answer_id, claim, 'unknown kind' FROM c WHERE kind NOT IN ('source_fact', 'analysis')
        UNION ALL SELECT answer_id, claim, 'no citation' FROM c WHERE len(cited) = 0 UNION ALL SELECT answer_id, claim, 'repeated citation' FROM c WHERE len(cited) <> len(list_distinct(cited))
        UNION ALL SELECT DISTINCT answer_id, claim, 'unknown citation: ' || u FROM (SELECT answer_id, claim, unnest(cited) AS u FROM c) WHERE u NOT IN (SELECT chunk_id FROM k)""",
    "turn_sources": f"""WITH {_TURNS}, u AS (SELECT answer_id, claim, unnest(cited) AS citation, unnest(range(len(cited))) AS p FROM c), f AS (SELECT answer_id, citation, min(claim * 1000 + p) AS o FROM u GROUP BY ALL)
        SELECT answer_id, citation, article_id, publisher, row_number() OVER (PARTITION BY answer_id ORDER BY o)::INT AS rank FROM f JOIN k ON chunk_id = citation""",
    "citation_validate": f"""WITH c(answer_id, claim, text, kind, cited) AS (VALUES {_CLAIM_VALUES}), k(chunk_id, article_id, publisher) AS (VALUES {_CHUNK_VALUES})
        SELECT answer_id, claim, 'empty text' AS violation FROM c WHERE trim(text) = '' UNION ALL SELECT answer_id, claim, 'unknown kind' FROM c WHERE kind NOT IN ('source_fact', 'analysis')
        UNION ALL SELECT answer_id, claim, 'no citation' FROM c WHERE len(cited) = 0 UNION ALL SELECT answer_id, claim, 'repeated citation' FROM c WHERE len(cited) <> len(list_distinct(cited))
        UNION ALL SELECT DISTINCT answer_id, claim, 'unknown citation: ' || u FROM (SELECT answer_id, claim, unnest(cited) AS u FROM c) WHERE u NOT IN (SELECT chunk_id FROM k)""",
    "answer_sources": f"""WITH c(answer_id, claim, text, kind, cited) AS (VALUES {_CLAIM_VALUES}), k(chunk_id, article_id, publisher) AS (VALUES {_CHUNK_VALUES}),
        u AS (SELECT answer_id, claim, unnest(cited) AS citation, unnest(range(len(cited))) AS p FROM c), f AS (SELECT answer_id, citation, min(claim * 1000 + p) AS o FROM u GROUP BY ALL)
        SELECT answer_id, citation, article_id, publisher, row_number() OVER (PARTITION BY answer_id ORDER BY o)::INT AS rank FROM f JOIN k ON chunk_id = citation""",
    "answer_violations": """SELECT * FROM (VALUES (2, 'empty answer'), (2, '2 to 4 sections'), (2, 'one of body or items'), (4, 'claims without evidence'), (5, 'insufficient is missing'), (5, 'empty heading'), (5, 'empty items'), (6, 'empty items'), (6, 'one of body or items')) v(answer_id, violation)""",
    "stream_events_order": f"WITH {_RUNS}, {_EVENTS} SELECT * FROM stream",
    "stream_terminal_state": f"""WITH {_RUNS}, {_EVENTS}, cut AS (SELECT * FROM stream WHERE NOT (answer_id % 6 = 0 AND type IN ('sources', 'insufficient', 'error', 'done')))
        SELECT answer_id, coalesce(arg_min(type, seq) FILTER (type IN ('sources', 'insufficient', 'error', 'done')), 'interrupted') AS ended FROM cut GROUP BY answer_id""",
}
