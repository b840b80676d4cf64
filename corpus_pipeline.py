"""From raw documents to token ids in five stages.

Each stage works on all that the one before kept; ``run`` writes each stage's
rows as Parquet to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from songfield.llm import jaccard, lattice, mixing, quality, substrings
from songfield.llm.common import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; a null or empty text doesn't. Repeated
    rows fare alike; columns keep their values, whatever they are called."""
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, whose five-word shingles are 80 percent
    the same, the document with the smallest id, and of
    repeated rows one. A document without an id can't be told from others by
    name, so it stays."""
    stays = jaccard.join(docs, n=5, percent=80).filter("doc_id = component_id").select("doc_id").distinct()
    named = docs.filter("doc_id IS NOT NULL").join(stays, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too. A null or
    empty text, and one without an id, stays as it is; equal rows are cut alike."""
    return substrings.remove(docs, substrings.find(docs)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; a null source is a source, and
    equal rows share their draw. Columns keep their values, whatever they are called."""
    return mixing.mix(docs, number=None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of each row, by the unigram table of the model's pieces; none
    for a null or empty text. A repeated row repeats its ids. ``docs`` is what was
    read again from files, so rows come in one order."""
    return lattice.encode(docs, settled=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("SentencePiece", token_ids),
]

#: Hash functions of Spark's and of numpy's decide in three stages, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
