"""A training corpus from raw documents: five stages, each one operator of glossweave.llm.

``STAGES`` names them in order; each takes (spark, docs, sf_dir) and gives what the next takes, all but the last with the
columns of documents. ``run`` writes each stage's result as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossweave.functions.session import stored, table
from glossweave.llm import decontaminate, jaccard, packing, quality, suffix_dedup
from glossweave.llm.tokenize import vocabulary


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars that fit the text."""
    return docs.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, a similarity of 0.8) the one with the smallest doc_id; documents without a doc_id stay."""
    found = jaccard.groups(docs, words=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without bytes of strings that a document with a smaller doc_id has."""
    return _counted(suffix_dedup.dedup(docs, cleaned=True), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of the benchmark."""
    return _counted(decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), cleaned=True), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL cannot state a fitted classifier or token ids; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
