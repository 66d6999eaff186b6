"""A corpus pipeline over documents: reject, dedup lines, dedup documents, mix, encode.

Each stage takes (spark, docs, sf_dir), reads all rows of docs and returns a
DataFrame; run() writes each as Parquet into the shared folder and reads it back.

Defined cases: null and empty texts are scored like any other by the first stage, have
no lines for the second, are nobody's duplicates, and have no tokens; rows of a null id
are scored, are neither source nor copy of lines, aren't duplicates, and come last in the
mix, without a position; rows of a null source follow the schedule; rows that repeat are
one document to the second stage and one component to the third, of which all rows with
the kept id stay; no rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import bpe, line_dedup, minhash_dedup, quality_classifier, source_mixing
from corpusflow.llm.common import stored, table
from corpusflow.llm.queries import tokenizer_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs, n_chars anew; a document of which nothing is left goes."""
    out = line_dedup.dedup_lines(docs)
    out = out.where("n_removed = 0 or n_removed < n_lines")
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix; Spark may read files in another, so encode() gives positions."""
    return source_mixing.in_mixed_order(docs, source_mixing.tempered(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests of every document with its position in the mix, in that order.

    Positions follow from docs' ids and sources, so they are those of the stage before,
    whatever order its files are read in.
    """
    place = source_mixing.places(docs, source_mixing.tempered(docs))
    out = bpe.encode(docs, tokenizer_path(), texts=False).join(place, F.col("doc_id") == F.col("__id"), "left")
    return out.orderBy(F.col("__position").asc_nulls_last(), "doc_id").drop("__id").withColumnRenamed("__position", "position")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_documents),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: No SQL: a discriminant, sketches and merges have none; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
