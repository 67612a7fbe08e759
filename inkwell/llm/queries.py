"""The registered queries of the training-data operators, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import classifier, decontaminate, language, merkle, mixing, ngram_join, pages, quality, secrets, substring_dedup, suffix_dedup, tokens
from inkwell.scratch import Scratch, spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark, "tokens").path
    return tokens.read(tokens.write(_documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select("doc_id", "item_id", "coverage", "n_tiles", "longest")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup(_documents(spark, sf_dir), keep="none"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_documents(spark, sf_dir)).select("doc_id", "class_id", "copy_id", "n_links")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup(_documents(spark, sf_dir), keep="none")
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.stored(_documents(spark, sf_dir))
    base_failed = ~quality.apply_policy(rows, "base")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality.apply_policy(rows, "v1").alias("kept"), "failed")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each rule of the policy rejects, and those that it alone rejects, from the stored ledger."""
    return quality.ablations(quality.stored(_documents(spark, sf_dir)), "v1")


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.scan(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_copied", "n_repos")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rows = language.identify(docs, language.train(language.learning_rows(docs)))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return rows.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle.manifest(_documents(spark, sf_dir), changed=tampered, changes={"text": merkle.lowered(F.col("text"))})


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = classifier.train(classifier.labelled(language.learning_rows(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return classifier.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_frames": op1_token_frames,
    "op2_decontaminate": op2_decontaminate,
    "op3_mix_sources": op3_mix_sources,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_secret_ownership": op8_secret_ownership,
    "op9_language_id": op9_language_id,
    "op10_page_text": op10_page_text,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_quality_classifier": op12_quality_classifier,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_LEDGER = rf"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        p AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, w FROM d),
        g AS (SELECT r, i, list_slice(w, i, i + 4) AS g FROM p WHERE i + 4 <= len(w)),
        t AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
        c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM t) GROUP BY r),
        s AS (SELECT r, count(*) FILTER (i > 1 AND w[i] = w[i - 1]) AS n FROM p GROUP BY r),
        l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
        ll AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
        m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                     len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(ll.dup, 0) AS n_dup_lines,
                     coalesce(c.n, 0) AS n_repeat_words, coalesce(s.n, 0) AS n_stutters, coalesce(ll.n, 0) AS n_lines
              FROM d LEFT JOIN c USING (r) LEFT JOIN s USING (r) LEFT JOIN ll USING (r)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
"""



def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR) || ':' || {column}::VARCHAR, '-')"


ORACLES: dict[str, str] = {
    "op3_mix_sources": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size,
                          ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
        c AS (SELECT *, (r - 1) % 3 + 1 AS w, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
        l AS (SELECT *, cap / w AS room, row_number() OVER o AS k,
                     (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM c WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
        t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, k) FROM l WHERE level <= room) * w) AS target FROM l),
        u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
        b AS (SELECT *, target - copies * source_size AS budget FROM u),
        x AS (SELECT d.*, b.source_size, b.target, b.copies, b.budget,
                     sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY d.source, h) AS m
              FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (size * (copies + CASE WHEN upto <= budget OR (upto - m <= budget AND upto - budget < budget - (upto - m)) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM x""",
    "op7_quality_rules": _LEDGER + r"""
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
               n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
               NOT base_failed AND NOT (10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_stutters > 3 * n_words
                   OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept,
               (1 * (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT
                + 16 * (10 * n_stutters > 3 * n_words)::INT + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 15 * n_words)::INT)::BIGINT AS failed
        FROM b""",
    "op11_merkle_manifest": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, concat({_field('doc_id')}, {_field('source')}, {_field('lang')}, {_field('n_chars')}) AS head, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
                          list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
                                      lambda c, b: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, b)), 4294967295::BIGINT) AS c FROM documents),
        l AS (SELECT doc_id, lang, sha256(concat(head, {_field('text')})) AS leaf,
                     sha256(concat(head, CASE WHEN xor(c, 4294967295) % 3 = 0 THEN {_field('lowered')} ELSE {_field('text')} END)) AS found FROM d),
        k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
        g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS n FROM k GROUP BY lang),
        p AS (SELECT g, i, doc_id, leaf, found FROM k JOIN g ON k.lang IS NOT DISTINCT FROM g.lang),
        t AS (SELECT g, 0 AS level, i, leaf AS node, n FROM p JOIN g USING (g)
              UNION ALL
              SELECT g, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM t WHERE n > 1 GROUP BY g, level, i // 8),
        s AS (SELECT g, level AS top, node AS subroot FROM t WHERE n = 1),
        u AS (SELECT 0 AS level, g AS i, subroot AS node, (SELECT count(*) FROM s) AS n FROM s
              UNION ALL
              SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM u WHERE n > 1 GROUP BY level, i // 8),
        nodes AS (SELECT g, level, i, node FROM t JOIN s USING (g) WHERE level < top
                  UNION ALL
                  SELECT g, top + u.level, u.i, u.node FROM u CROSS JOIN s WHERE u.n > 1),
        runs AS (SELECT g, level, i // 8 AS run, list(node ORDER BY i) AS nodes FROM nodes GROUP BY g, level, i // 8),
        walk AS (SELECT p.g, p.i AS row, p.leaf, p.found, s.subroot, s.top, level, run, nodes,
                        CASE WHEN level < top THEN p.i // (8::BIGINT ** level)::BIGINT ELSE p.g // (8::BIGINT ** (level - top))::BIGINT END AS place
                 FROM p JOIN s USING (g) JOIN runs USING (g)
                 WHERE run = CASE WHEN level < top THEN p.i // (8::BIGINT ** (level + 1))::BIGINT ELSE p.g // (8::BIGINT ** (level - top + 1))::BIGINT END),
        steps AS (SELECT g, row, level, array_to_string(nodes[1 : place % 8], '') AS before, array_to_string(nodes[place % 8 + 2 :], '') AS after FROM walk),
        paths AS (SELECT g, row, list({{'b': before, 'a': after}} ORDER BY level) AS steps, string_agg(before || after, '' ORDER BY level) AS siblings FROM steps GROUP BY g, row),
        f AS (SELECT p.g, p.i, p.doc_id, p.leaf, s.subroot, sha256(coalesce(siblings, '')) AS proof_sha256,
                     list_reduce(coalesce(steps, []), lambda h, x: {{'b': sha256(x.b || h.b || x.a), 'a': ''}}, {{'b': found, 'a': ''}}).b AS folded_root
              FROM p JOIN s USING (g) LEFT JOIN paths ON paths.g = p.g AND paths.row = p.i)
        SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
        FROM f CROSS JOIN (SELECT node AS root FROM u WHERE n = 1)""",
}

#: Queries beside the ten operators' own, read from what these store.
REPORTS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"quality_ablations": quality_ablations}
REPORT_ORACLES: dict[str, str] = {
    "quality_ablations": _LEDGER
    + r"""
        , f AS (SELECT [n_words < 10, 100 * n_repeat_words > 20 * n_words, 10 * n_symbols > n_words, 2 * n_dup_lines > n_lines,
                        10 * n_stutters > 3 * n_words, word_chars < 2 * n_words, word_chars > 15 * n_words] AS hits FROM b),
        r AS (SELECT unnest(['too_few_words', 'repeated_windows', 'symbol_heavy', 'duplicate_lines', 'stutter', 'short_words', 'long_words']) AS rule,
                     unnest([1, 2, 3, 4, 5, 6, 7]) AS i)
        SELECT rule, coalesce(sum(CASE WHEN hits[i] THEN 1 ELSE 0 END), 0)::BIGINT AS failing,
               coalesce(sum(CASE WHEN hits[i] AND len(list_filter(hits, lambda x: x)) = 1 THEN 1 ELSE 0 END), 0)::BIGINT AS only_this
        FROM f, r GROUP BY rule"""
}
