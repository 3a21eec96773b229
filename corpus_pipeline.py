"""A training corpus from ``documents``: five stages, each one operator of ``innerscan.llm``.

Every stage takes (spark, docs, sf_dir) and returns what it keeps; all but
the last return the columns of ``documents``.  The stages are written as
Parquet in the shared folder and read again, so each is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innerscan.llm import line_dedup as lines
from innerscan.llm import mixing as sources
from innerscan.llm import near_dedup as near
from innerscan.llm import packing as sequences
from innerscan.llm import toxicity as severity
from innerscan.llm.common import materialize, table

#: The near_dedup stage's least Jaccard index in percent, lower than that of ``op6_minhash``; its banding misses a pair there with a probability of 6e-7.
NEAR_PERCENT, NEAR_BANDS, NEAR_ROWS = 80, 36, 5


def like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the changed text."""
    out = changed.select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model finds clean; a null or empty text has no evidence and is judged by the thresholds."""
    return severity.drop_toxic(docs, severity.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many repeat; null text becomes empty."""
    return like(docs, lines.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates, at an index of 0.8 or more; empty texts stay."""
    return near.drop_near_duplicates(docs, percent=NEAR_PERCENT, bands=NEAR_BANDS, rows=NEAR_ROWS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, a row for each time that a document is taken."""
    return like(docs, sources.mixed_documents(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return sequences.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: A learned classifier, sketches and a tokenizer can't be said in SQL; tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
