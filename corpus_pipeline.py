"""Five stages from raw documents to token ids, each written as Parquet and reread by the next.

All stages take empty tables, nulls in any column, texts of any length,
repeated rows and further columns of any name; those but the last return the
columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import discard, intermediates, materialise, tables
from lectern.llm.decontam import decontaminate
from lectern.llm.exact import exact_dedup
from lectern.llm.neardup import jaccard_dedup
from lectern.llm.quality import quality_filter
from lectern.llm.sentencepiece import tokenised


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.7 go; the classifier learns from labels of this stage's own documents.

    Null and empty texts score by the bias; without a usable label all stay.
    """
    return quality_filter(docs, tables(spark, sf_dir, "labels"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id stays (nulls last and null texts as empty ones), of repeated rows one."""
    return exact_dedup(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles the one with the least id stays.

    Balls around SimHash fingerprints tell the first candidates, bands of MinHash
    values those that differ by more bits; sets decide.  Texts without words are alike; rows that share an id stay or go together;
    a group in which no row has an id stays whole.
    """
    return jaccard_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item within its edit budget go; those without a text stay."""
    return decontaminate(docs, tables(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left as token ids, with none for a null or empty text."""
    return tokenised(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", dedup_exact),
    ("near_dedup", dedup_near),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

ORACLE_SQL = None  # four of the stages are beyond SQL; tests hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; what a stage wrote for itself, and its own table once the next has read it, is deleted."""
    docs = tables(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with intermediates(spark) as made:
            after = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            made.pop()
        if k:
            discard(spark, docs)
        docs = after
    return docs
