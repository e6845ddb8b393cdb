"""Corpus pipeline: from raw documents to packed training sequences.

Every stage works on all its predecessor kept; stages but the last return the
columns of ``documents``. Between stages the rows are written as Parquet to the
shared folder and read again, which cuts the lineage. Every stage takes null
ids, null and empty texts, repeated rows, long texts (read whole), further
columns of any name (kept, but by the last stage) and empty tables (no rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import jaccard_join, line_dedup, mixing, packing, quality_classifier
from tempograph.llm.common import scratch
from tempograph.llm.queries import tokenizer_file


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other, a score of 0.5 is kept;
    repeated rows are judged alike.
    """
    return quality_classifier.drop_low_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; no document goes.

    The first by id stays, null ids come last, then rows in their order: a
    repeated row loses its lines. Null texts stay null, others may become empty.
    """
    return line_dedup.dedup_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by shingles (five words, Jaccard 0.8) the smallest id stays, of equal ids the first row.

    Null and empty texts are linked with nothing and all stay; null ids stay
    only where their group has no other.
    """
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights.

    Texts without words go, null sources are one source, repeated rows are
    documents of their own, ties go by a seeded hash and then by row.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences, each with its token ids.

    A null or empty text is the end id alone; repeated rows are packed each;
    equal lengths are packed in the order they come in.
    """
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The classifier, the mix and the packing have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
