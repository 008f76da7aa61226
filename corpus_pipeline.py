"""A corpus pipeline of the operators in obsidia.llm: STAGES in order, each reread from Parquet by the next."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from obsidia.llm import benchmarks, language, lines, near_duplicates, packing
from obsidia.llm.common import shared_dir, table

#: Documents whose best language is less sure than this are rejected; nearly all clean ones score above 0.9.
MIN_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts, texts without letters, and unsure predictions.

    Labels come from the given documents. What is kept keeps its columns; every row is judged by its own text.
    """
    return language.keep_identified(docs, language.train(docs), MIN_SCORE)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one line of each class of near-duplicate lines; texts and n_chars follow. Null ids and texts stay as they are, and a
    document whose every line goes keeps an empty text."""
    return lines.without_duplicates(docs)


def dedupe_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates. Rows are judged by their own text: of a repeated id with different
    texts each stays or goes for itself; of rows equal in id and text one stays; rows with a null id or text stay."""
    return near_duplicates.without_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each judged by its own text; null ids and texts stay."""
    return benchmarks.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows; an empty text is its end mark alone."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("lines", dedupe_lines),
    ("near_duplicates", dedupe_documents),
    ("decontaminate", decontaminate),
    ("pack", pack),
]
#: SQL can't express the classifier, MinHash classes or the tokenizer; tests/llm compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. An empty table gives none; repeated rows, nulls and ties are treated as each stage says."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
