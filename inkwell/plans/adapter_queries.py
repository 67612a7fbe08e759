"""Digests by their layouts' own rules, whole reader pages, checked queues and full record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.functions import markdown, scores
from inkwell.operators import answers, archive, chunks, editorial, keeping, ledger
from inkwell.plans import bindings as b
from inkwell.plans.document_queries import _CHUNKS, _VERIFIED
from inkwell.sources import adapters

_HOUSES = {"bcg": "BCG", "bilingual-analysis": "Mc Kinsey", "mit": "MIT", "bain": "Bain & Co"}
_ATTRS = "data-score='8{k}' data-priority='Must  Read' data-category='operations'"
#: One card of each layout; {n} is the page, {k} the card.
_CARDS = {
    "bcg": "<article class='article-card' id='article-{k}' data-categories='ops|org' data-priority='Must  Read'><div class='meta'><span>Report</span><span>Ann {k}</span></div><div class='date'>2026-07-0{k}</div><h3>Title <b>{k}</b></h3><div class='translated-title'>题 {k}</div><div class='score'>High · {k}/10</div>"
    "<section><h4>核心观点</h4><p>core {n}</p></section><section><h4>关键证据</h4><p>proof {n}</p></section><section><h4>影响面</h4>all of it</section><section><h4>致 Amer Sports / Salomon</h4><p>for us</p></section><section><h4>CDIO Office</h4><p class='confidence'>Confidence: Medium, why</p></section>"
    "<span class='chip geo'>CN</span><span class='chip horizon'>6m</span><span class='chip domain'>IT</span><footer><a href='https://x.example/{n}/{k}?utm_source=d&amp;q=1#top'>s</a></footer><a href='https://y.example'>y</a></article>",
    "bilingual-analysis": f"<article class='analysis-card' data-radar-id='r{{k}}' id='e{{k}}' {_ATTRS}><p class='eyebrow'>x · 2026-07-0{{k}}</p><h3><span data-lang-content='zh'>题 {{k}}</span><span data-lang-content='en'>Title {{k}}</span></h3>"
    "<div class='chips'><span>must-read</span><span>Confidence: high</span><span>CV 30/35 IB 20/25 SR 21/25 ES 1{k}/15</span><span>Survey</span></div><div class='take'><p><i data-lang-content='en'>Core {n}</i><i data-lang-content='zh'>核心 {n}</i></p></div>"
    "<section><h4>Key evidence</h4><ul><li><span data-lang-content='zh'>证 {n}</span><span data-lang-content='en'>Proof {n}</span><small>p. 1</small><small>p. {k}</small></li><li>只有 <small>注</small></li></ul></section><section><h4>影响范围</h4><p>影响 {n}</p></section><section class='implication'><p><b data-lang-content='zh'>启示</b></p></section>"
    "<footer><p><span data-lang-content='zh'>理由</span></p><a href='https://x.example/{n}/{k}/'>s</a></footer></article>",
    "mit": f"<article class='article-card' data-radar-id='r{{k}}' {_ATTRS}><p class='source-title'>Title {{k}}</p><h3>题 {{k}}</h3><div class='article-body' data-lang-content='zh'><section><h4>核心观点</h4><p>核心 {{n}}</p></section><div class='evidence'><li>证 <small>p. 1</small></li><li>证二</li></div><section><h4>影响</h4><p>影响 {{n}}</p></section><p class='confidence'>low: few</p></div>"
    "<div class='article-body' data-lang-content='en'><section><h4>Core view</h4><p>Core {n}</p></section><div class='evidence'><li>Proof</li></div></div><footer><span>on 2026-07-0{k}</span><span class='metric'>30/35 20/25 21/25 1{k}/15</span><a href='https://x.example/{n}/{k}'>s</a></footer></article>",
    "bain": f"<article class='article-card' data-radar-id='r{{k}}' {_ATTRS}><p class='eyebrow'>2026-07-0{{k}} · Brief</p><p class='original-title'>ORIGINAL · Title {{k}}</p><h3>题 {{k}}</h3><p class='scoreline'>Content 30 Impact 20 Relevance 21 Evidence 1{{k}} · middle</p><p class='confidence'>理由</p><div class='core'><p data-lang-content='en'>Core {{n}}</p><p data-lang-content='zh'>核心 {{n}}</p></div>"
    "<section><h4>关键证据</h4><p>证 {n} <a class='locator' href='#'>p. {k}</a></p></section><section><h4>Impact</h4><p>影响 {n}</p></section><a href='https://x.example/{n}/{k}'>s</a></article>",
}


def _digests(spark, sf):
    """pages as digests of the four layouts in turn, two cards each."""
    i = F.col("page_id")

    def card(layout, k):
        parts = _CARDS[layout].replace("{k}", str(k)).split("{n}")
        return F.concat(*[x for n, p in enumerate(parts) for x in ([F.lit(p)] if n == 0 else [i, F.lit(p)])])

    body = F.lit("")
    for n, layout in enumerate(_CARDS):
        body = F.when(i % 4 == n, F.concat(card(layout, 1), card(layout, 2))).otherwise(body)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % 4 + 1).cast("int"))
    return b.table(spark, sf, "pages").select(i.cast("string").alias("digest"), F.concat(F.lit("<title> D  "), i, F.lit("</title><body>"), body).alias("html"), pick(list(_CARDS)).alias("adapter"), pick(_HOUSES.values()).alias("publisher"), F.concat(F.lit("D "), i).alias("title"), F.lit(2).alias("expected"))


def _records(spark, sf):
    """The ledger's rows as full records with planted faults."""
    d = F.col("doc_id")
    dims = [F.when(d % 3 != 0, F.lit(v) + F.when(d % 29 == k, 30.0).otherwise(0.0)).alias(n) for k, (n, v) in enumerate(zip(scores.MAXIMA, (27.0, 20.0, 21.0, 12.0), strict=True))]
    return b.ledger(spark, sf).select(
        d.alias("place"), F.when(d % 13 != 0, F.col("id")).alias("id"), F.when(d % 17 != 0, "radar").otherwise("").alias("radar_title"), F.lit("p").alias("publisher"), F.when(d % 19 == 0, "http://x").when(d % 23 != 0, "https://x").alias("source_url"), F.lit("t").alias("title_original"),
        F.lit("track").alias("priority"), F.when(d % 31 != 0, "file").alias("provenance"), *dims, F.when(d % 37 == 0, 1.0).otherwise(80.0).alias("total"),
    )


def _readers(spark, sf):
    d = F.col("doc_id")
    return b.table(spark, sf, "documents").select(
        d.alias("id"), F.concat(F.lit("题 & "), d).alias("title_zh"), F.col("source").alias("publisher"), F.concat(F.lit("https://x.example/?a=1&b="), d).alias("source_url"), F.when(d % 2 == 0, "A <b>").alias("title_original"), F.when(d % 3 == 0, "2026-08-01").alias("published_at"), F.lit("治理").alias("category"),
        F.lit("").alias("priority"), F.when(d % 5 == 0, "要点").alias("summary"), (d % 7 == 0).alias("has_pdf"), F.lit("# 标题\n\n正文 **重点**").alias("markdown"),
    )


def _page_faults(spark, sf):
    articles, d = _readers(spark, sf), F.col("id")
    pages = editorial.readers(articles)
    h = F.when(d % 11 == 0, F.replace("html", F.lit("</article>"), F.lit("<script></article>"))).when(d % 11 == 1, F.replace("html", F.lit("utf-8"), F.lit("gbk"))).when(d % 11 == 2, F.replace("html", F.lit("题 &amp; "), F.lit(""))).when(d % 11 == 3, F.replace("html", F.lit(markdown.PDF), F.lit("x.pdf"))).when(d % 11 == 4, "").otherwise(F.col("html"))
    return editorial.page_violations(pages.withColumn("html", h), articles)


def _answers(spark, sf):
    """conversations as answers of 0 to 5 sections, with faults by rule."""
    c, n = F.col("conv_id"), F.col("n")
    turns = b.table(spark, sf, "conversations").groupBy(c).agg(F.count("*").alias("n"))
    one = F.struct(F.when(c % 5 == 0, " ").otherwise("head").alias("heading"), F.when(c % 3 != 0, "body").alias("body"), F.when(c % 7 == 0, F.array(F.lit(""))).when(c % 3 == 0, F.array(F.lit("item"))).alias("items"))
    sections = F.when(c % 11 != 0, F.when(c % 6 > 0, F.array_repeat(one, (c % 6).cast("int"))).otherwise(F.array().cast("array<struct<heading:string,body:string,items:array<string>>>")))
    return turns.select(c.alias("answer_id"), F.when(c % 13 != 0, "answer").otherwise("").alias("answer"), F.when(c % 17 != 0, c % 4 == 0).alias("insufficient"), sections.alias("sections"), (n % 3).cast("int").alias("n_claims"))


_ARTICLE_HEAD = "'<!doctype html>' || chr(10) || '<html lang=\"zh-CN\">' || chr(10)"

QUERIES = {
    "adapter_records": lambda s, sf: adapters.scan(_digests(s, sf)).select(
        "digest", "id", "element_id", "title_original", "title_zh", "published_at", "document_type", "author", "category", F.array_join("topics", "|").alias("topics"), F.array_join(F.concat("geography", "horizon", "domains"), "|").alias("tags"), "priority", "tier", "score", "scale", "content", "impact", "relevance", "evidence",
        "confidence", "confidence_reason", "core_original", "core_zh", "impact_zh", "implication_zh", F.array_join(F.transform("proofs", lambda p: F.concat_ws("/", F.coalesce(p.original, F.lit("-")), F.coalesce(p.zh, F.lit("-")), F.coalesce(p.locator, F.lit("-")))), ";").alias("proofs"), "source_url", "canonical_url",
    ),
    "record_errors": lambda s, sf: ledger.record_errors(_records(s, sf)),
    "reader_pages": lambda s, sf: editorial.readers(_readers(s, sf)),
    "reader_page_violations": _page_faults,
    "answer_rules": lambda s, sf: answers.answer_violations(_answers(s, sf)),
    "queue_checked": lambda s, sf: archive.queue_checked(b.pairs(s, sf).withColumn("archive_index", F.col("id"))).select("id", "status", "errors", "source_characters"),
    "directory_order": lambda s, sf: archive.in_reader_order(keeping.directories(b.ledger(s, sf).select(F.col("id"), F.lit(1).alias("archive_index"), "title")).join(b.ledger(s, sf).select("id", "publisher"), "id")),
    "corpus_totals": lambda s, sf: chunks.nested(chunks.chunk(b.table(s, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text"), b.table(s, sf, "documents").select(F.col("doc_id").alias("id"), "source")).agg(F.count("*").alias("articles"), F.sum(F.size("chunks")).alias("chunks")),
}


def _by(*values):
    return "CASE page_id % 4 " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_E = "replace(replace({c}, '&', '&amp;'), '<', '&lt;')"

ORACLES = {
    "adapter_records": f"""SELECT page_id::VARCHAR AS digest, {_by("'bcg-' || k", "'mc-kinsey-r' || k", "'mit-r' || k", "'bain-co-r' || k")} AS id, {_by("'article-' || k", "'e' || k", "'r' || k", "'r' || k")} AS element_id, 'Title ' || k AS title_original, '题 ' || k AS title_zh, '2026-07-0' || k AS published_at,
        {_by("'Report'", "'Survey'", "'article'", "'Brief'")} AS document_type, {_by("'Ann ' || k", "NULL", "NULL", "NULL")} AS author, {_by("'ops'", "'operations'", "'operations'", "'operations'")} AS category, {_by("'ops|org'", "'operations'", "'operations'", "'operations'")} AS topics, {_by("'CN|6m|IT'", "''", "''", "''")} AS tags, 'must-read' AS priority,
        {_by("'high'", "NULL", "NULL", "NULL")} AS tier, {_by("k", "80 + k", "80 + k", "80 + k")}::DOUBLE AS score, {_by("10", "100", "100", "100")}::INT AS scale, {_by("NULL", "30", "30", "30")}::INT AS content, {_by("NULL", "20", "20", "20")}::INT AS impact, {_by("NULL", "21", "21", "21")}::INT AS relevance, {_by("NULL", "10 + k", "10 + k", "10 + k")}::INT AS evidence,
        {_by("'middle'", "'high'", "'low'", "'middle'")} AS confidence, {_by("'Confidence: Medium, why'", "'理由'", "'low: few'", "'理由'")} AS confidence_reason, {_by("NULL", "'Core ' || page_id", "'Core ' || page_id", "'Core ' || page_id")} AS core_original, {_by("'core ' || page_id", "'核心 ' || page_id", "'核心 ' || page_id", "'核心 ' || page_id")} AS core_zh,
        {_by("'影响面all of it'", "'影响 ' || page_id", "'影响 ' || page_id", "'影响 ' || page_id")} AS impact_zh, {_by("'for us'", "'启示'", "NULL", "NULL")} AS implication_zh,
        {_by("'-/proof ' || page_id || '/-'", "'Proof ' || page_id || '/证 ' || page_id || '/p. ' || k || ';-/只有/注'", "'Proof/证/p. 1;-/证二/-'", "'-/证 ' || page_id || '/p. ' || k")} AS proofs,
        'https://x.example/' || page_id || '/' || k || {_by("'?utm_source=d&q=1#top'", "'/'", "''", "''")} AS source_url, 'https://x.example/' || page_id || '/' || k || {_by("'?q=1'", "''", "''", "''")} AS canonical_url
        FROM pages, (VALUES (1), (2)) v(k)""",
    "record_errors": " UNION ALL ".join([
        *[f"SELECT doc_id AS place, 'missing {c}' AS error FROM documents WHERE doc_id % {m} = 0{more}" for c, m, more in (("id", 13, ""), ("radar_title", 17, ""), ("source_url", 23, " AND doc_id % 19 <> 0"), ("provenance", 31, ""))],
        "SELECT doc_id, 'source_url is not https' FROM documents WHERE doc_id % 19 = 0", *[f"SELECT doc_id, 'invalid {c}' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 29 = {k}" for k, c in enumerate(scores.MAXIMA)],
        "SELECT doc_id, 'total is not the sum' FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 29 > 3 AND doc_id % 37 = 0",
    ]),
    "reader_pages": f"""WITH a AS (SELECT doc_id AS id, doc_id % 7 = 0 AS has_pdf, '题 &amp; ' || doc_id AS t, {_E.replace('{c}', 'source')} AS p, 'https://x.example/?a=1&amp;b=' || doc_id AS u FROM documents),
        n AS (SELECT *, '<nav class="reader-nav" aria-label="文章导航"><a href="/">← 返回知识库</a>' || CASE WHEN has_pdf THEN '<a href="{markdown.PDF}" target="_blank" rel="noreferrer">查看原始报告 PDF ↗</a>' ELSE '' END || '<a href="' || u || '" target="_blank" rel="noreferrer">查看官网原文 ↗</a></nav>' AS nav FROM a)
        SELECT id, has_pdf, {_ARTICLE_HEAD} || '<head>' || chr(10) || '<meta charset="utf-8">' || chr(10) || '<meta name="viewport" content="width=device-width, initial-scale=1">' || chr(10) || '<meta name="description" content="' || t || '的完整中文译文">' || chr(10) || '<title>' || t || ' · ' || p || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
            || '<header class="reader-shell">' || nav || '<p class="reader-kicker">' || p || ' · {markdown.KICKER}</p><h1>' || t || '</h1>' || CASE WHEN id % 2 = 0 THEN '<p class="original-title" lang="en">A &lt;b&gt;</p>' ELSE '' END
            || '<div class="meta-row">' || CASE WHEN id % 3 = 0 THEN '<span><b>发布日期</b>2026-08-01</span>' ELSE '' END || '<span><b>文章类别</b>治理</span></div></header>' || chr(10) || '<main class="reader-main"><p class="translation-note">{markdown.NOTE}</p>'
            || CASE WHEN id % 5 = 0 THEN '<section class="summary" aria-labelledby="summary-title"><h2 id="summary-title">核心导读</h2><p>要点</p></section>' ELSE '' END || '<article class="article-body"><h1>标题</h1><p>正文 <strong>重点</strong></p></article></main>' || chr(10)
            || '<footer class="reader-shell reader-footer">' || nav || '<p>{markdown.FOOT}</p></footer>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10) AS html FROM n""",
    "reader_page_violations": """SELECT doc_id AS id, v AS violation FROM documents, (VALUES (0, 'unsafe'), (1, 'no charset'), (2, 'names missing'), (4, 'empty'), (4, 'names missing'), (4, 'no charset')) x(k, v) WHERE doc_id % 11 = k
        UNION ALL SELECT doc_id, v FROM documents, (VALUES (3, 'report links missing'), (3, 'report links not expected'), (4, 'report links missing'), (4, 'report links not expected')) x(k, v) WHERE doc_id % 11 = k AND doc_id % 7 = 0""",
    "answer_rules": """WITH a AS (SELECT conv_id AS c, count(*) AS n FROM conversations GROUP BY conv_id), x AS (SELECT *, CASE WHEN c % 17 <> 0 THEN c % 4 = 0 END AS weak, CASE WHEN c % 11 <> 0 THEN c % 6 END AS k FROM a)
        SELECT c AS answer_id, 'empty answer' AS violation FROM x WHERE c % 13 = 0 UNION ALL SELECT c, 'insufficient is missing' FROM x WHERE weak IS NULL UNION ALL SELECT c, '2 to 4 sections' FROM x WHERE k IS NOT NULL AND k NOT BETWEEN 2 AND 4 OR (k IS NULL AND weak = FALSE)
        UNION ALL SELECT c, 'empty heading' FROM x WHERE k > 0 AND c % 5 = 0 UNION ALL SELECT c, 'one of body or items' FROM x WHERE k > 0 AND c % 3 <> 0 AND c % 7 = 0 UNION ALL SELECT c, 'empty items' FROM x WHERE k > 0 AND c % 7 = 0 UNION ALL SELECT c, 'claims without evidence' FROM x WHERE weak AND n % 3 > 0""",
    "queue_checked": f"WITH {_VERIFIED} SELECT p.id, CASE WHEN trim(translation) = '' THEN 'pending' WHEN len(e) = 0 THEN 'complete' ELSE 'invalid' END AS status, CASE WHEN trim(translation) <> '' AND len(e) > 0 THEN array_to_string(e, ',') END AS errors, length(source)::INT AS source_characters FROM pairs p JOIN verified v ON v.id = p.id",
    "directory_order": rf"""WITH {b.LEDGER}, t AS (SELECT id, publisher, regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\p{{M}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM ledger), d AS (SELECT id, publisher, '001-' || CASE WHEN s = '' THEN 'untitled' ELSE regexp_replace(substr(s, 1, 96), '-+$', '') END AS directory FROM t)
        SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY directory COLLATE zh, directory, id)::INT AS place FROM d""",
    "corpus_totals": f"WITH RECURSIVE {_CHUNKS} SELECT (SELECT count(*) FROM documents) AS articles, count(*)::BIGINT AS chunks FROM chunks",
}
