"""A corpus pipeline: language ID, near duplicates, decontamination, mixing, token files.

Every stage reads all that its predecessor kept, from Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import decontaminate, language, mixing, ngram_join, tokens
from inkwell.scratch import Scratch, spread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, all columns.

    Null texts and texts without a letter go; copies are judged alike; null and repeated ids are
    kept as they are; where no document has a language and letters nothing can be judged and all
    stay; an empty table stays empty.
    """
    return language.known(docs, language.train(language.learning_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, all columns: five words, a similarity of 0.8.

    The one of the least id stays, then of the least content hash; null ids come last. Rows that
    repeat id and text are one document; texts without a word (null, empty, blank) link to none and
    all stay; an empty table stays empty.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, all columns.

    Null and empty texts and items never match; copies go or stay together; null and repeated ids
    are kept as they are; an empty benchmark or table changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the sources' targets take them, all columns.

    A null source is a source. Rows of null or equal ids are told apart by all their columns, of
    wholly equal rows a number is taken; texts without a word have no size and are taken only in
    whole copies of their source; an empty table stays empty.
    """
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; what a reader finds in them, in the order of ids (null first), then content.

    A null text has only the end id; repeats of a document stand one behind the other; an empty
    table gives no rows.
    """
    import public_tokenizers

    return tokens.read(tokens.write(docs, Scratch(spark, "tokens").path, public_tokenizers.path("word_bpe_49k.json"), end_id=2))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("mix_sources", mix_sources),
    ("token_frames", write_tokens),
]

#: Compression, tiling and the tokenizer can't be said in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scratch, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)  # nothing reads a stage's rows but the next one
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
