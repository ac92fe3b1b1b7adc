"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold; keeps a Python worker's memory flat for any text length.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Limit what one Arrow batch carries to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. On one machine (master local) a temporary one may take its place."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brindle-")
        sc.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written once to the shared folder: later steps neither recompute it nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """`df` checkpointed, in no more partitions than give each `rows` rows: a small table is not spread over many tiny files."""
    done = checkpointed(df)
    return done.coalesce(1 + done.count() // rows)


def scratch(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id and text (null: empty) under fixed names, so that other columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def lit_array(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
