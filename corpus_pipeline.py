"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept and returns the columns of documents; the last one
returns the packed pieces. Between stages the rows are written to the shared folder, so that a lost
executor costs no more than its part of one stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontaminate, line_dedup, near_dedup, packing, quality
from brindle.llm.common import scratch, table


def counted(docs: DataFrame) -> DataFrame:
    """n_chars after a change of text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others; repeated rows stay or go alike; columns of any name pass through."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first (by doc_id, then place) stays; documents that lose all their lines go.

    Blank lines are never duplicates, so null, empty and blank texts stay. n_chars is counted anew.
    """
    return counted(line_dedup.dedup_lines(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the smallest (doc_id, text). Texts without words are alike if equal (null is empty);
    rows without doc_id stay; of rows that repeat id and text one stays."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are more than half benchmark text go. Null and empty texts stay; n_chars is counted anew."""
    return counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, one row each; a null or empty text is one end token, repeated rows give pieces each, an empty table none."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Most stages have no SQL form; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
