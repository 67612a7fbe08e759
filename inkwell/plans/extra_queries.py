"""Small operators of the interface, the collection checks and the files."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import answers, archive, decisions, dialogue
from inkwell.plans import bindings as b
from inkwell.plans.document_queries import _built
from inkwell.plans.ledger_queries import _QUEUE, _queue
from inkwell.plans.search_queries import _EVENTS, _RUNS, _runs

MESSAGES = [" 你好！ ", "Thank you.", "再见。", "怎么用？", "what is AI", "", "H i", "Hello, world"]
DOMAIN_ROWS = [("hr", "HR AI 机会雷达"), ("supply-chain", "供应链 AI 机会雷达"), ("other", "Title")]
PUBLISHERS = ["src7", "src2", "src11"]


def _inspections(spark, sf):
    p = b.table(spark, sf, "pages").where("page_id % 3 != 0")
    return p.groupBy("url").agg(F.max(F.lit(200)).alias("http"), F.min(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.max(F.length("html")).alias("characters"))


def _cases(spark, sf):
    i = F.col("ordinal")
    return b.scenarios(spark, sf).where(i % 4 == 0).select("library", F.concat(F.lit("c"), i % 3).alias("company"), F.when(i % 8 == 0, "中国").otherwise("国际").alias("market"))


QUERIES = {
    "message_intents": lambda s, sf: s.createDataFrame(list(enumerate(MESSAGES)), "id int, message string").select("id", dialogue.intent(F.col("message")).alias("intent")),
    "conversation_intents": lambda s, sf: b.table(s, sf, "conversations").where("role = 'user'").groupBy(F.coalesce(dialogue.intent(F.col("text")), F.lit("search")).alias("intent")).agg(F.count("*").alias("n")),
    "domain_labels": lambda s, sf: s.createDataFrame(DOMAIN_ROWS, "domain string, title string").select("domain", dialogue.domain_label(F.col("domain"), F.col("title")).alias("label")),
    "library_violations": lambda s, sf: decisions.library_violations(_built(s, sf), _cases(s, sf)),
    "publisher_order": lambda s, sf: archive.by_publisher_rank(_queue(s, sf).select("id", "publisher", "archive_index"), PUBLISHERS),
    "inspection_join": lambda s, sf: archive.inspected(b.table(s, sf, "pages").select("page_id", "url"), _inspections(s, sf)).select("page_id", "inspection.http", "inspection.title", "inspection.characters", F.col("inspection").isNotNull().alias("inspected")),
    "event_json_lines": lambda s, sf: answers.events(_runs(s, sf)).select("answer_id", "seq", F.to_json(F.struct("type", "stage")).alias("line")),
}

_VALUES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(MESSAGES))
_PLAIN = r"regexp_replace(lower({c}), '[\s，。！？!?、,.]+', '', 'g')"


def _intent(col):
    return "CASE " + " ".join(f"WHEN regexp_full_match({_PLAIN.replace('{c}', col)}, '{words}') THEN '{name}'" for name, words in dialogue.INTENTS.items()) + " END"


ORACLES = {
    "message_intents": f"WITH m(id, message) AS (VALUES {_VALUES}) SELECT id, {_intent('message')} AS intent FROM m",
    "conversation_intents": f"SELECT coalesce({_intent('text')}, 'search') AS intent, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY 1",
    "domain_labels": "SELECT * FROM (VALUES ('hr', '人力资源'), ('supply-chain', '供应链'), ('other', 'Title')) v(domain, label)",
    "library_violations": f"""WITH {b.SCENARIOS}, n AS (SELECT library, count(*) AS n FROM built GROUP BY library), h AS (SELECT library, count(DISTINCT ordinal % 3) AS c FROM built WHERE ordinal % 8 = 0 GROUP BY library)
        SELECT library, '20 to 30 scenarios' AS violation FROM n WHERE n NOT BETWEEN 20 AND 30 UNION ALL SELECT library, 'each rank once' FROM n WHERE n < 12
        UNION ALL SELECT library, 'companies of the home market' FROM n LEFT JOIN h USING (library) WHERE coalesce(c, 0) < 2""",
    "publisher_order": f"WITH {_QUEUE}, r AS (SELECT id, publisher, archive_index, CASE publisher WHEN 'src7' THEN 0 WHEN 'src2' THEN 1 WHEN 'src11' THEN 2 ELSE 99 END::INT AS rank FROM queue) SELECT *, row_number() OVER (PARTITION BY rank ORDER BY archive_index, id)::INT AS turn FROM r",
    "inspection_join": """WITH i AS (SELECT url, 200::INT AS http, min(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, max(length(html))::INT AS characters FROM pages WHERE page_id % 3 <> 0 GROUP BY url)
        SELECT page_id, http, title, characters, i.url IS NOT NULL AS inspected FROM pages p LEFT JOIN i ON i.url = p.url""",
    "event_json_lines": f"""WITH {_RUNS}, {_EVENTS} SELECT answer_id, seq, '{{"type":"' || type || '"' || CASE WHEN stage IS NOT NULL THEN ',"stage":"' || stage || '"' ELSE '' END || '}}' AS line FROM stream""",
}
