"""Versioned tables that grow by layers: a change writes what is new and the keys that it replaces, and nothing else.

A store is a folder with one folder per table and, in it, one per version. A row of version w holds until
a later version lists its key as gone. The table `head` is written last and makes a version visible, so a
failed or lost job leaves no half version, and older versions stay readable.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Missing(LookupError):
    """Nothing is stored where a store was expected."""


@dataclass(frozen=True)
class Store:
    """Version `version` of the store at `path`; layers before `base` no longer count. `facts` is the head's row."""

    spark: SparkSession
    path: str
    version: int
    base: int
    facts: dict

    def layer_numbers(self) -> range:
        return range(self.base, self.version + 1)

    def table(self, name: str) -> DataFrame:
        """All layers of a table, with their version: folders of other versions are not read."""
        folder = f"{self.path}/{name}"
        return self.spark.read.option("basePath", folder).parquet(*[f"{folder}/version={v}" for v in self.layer_numbers()])

    def latest(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}/version={self.version}")

    def gone(self) -> DataFrame:
        """key and the last version that replaced or removed it."""
        return self.table("gone").groupBy("key").agg(F.max("version").alias("gone_at"))

    def live(self, name: str, *keys: str) -> DataFrame:
        """Rows of a table none of whose keys has gone in a later version."""
        return self.still(self.table(name), *keys).drop("version")

    def still(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Those of given rows, with their version, none of whose keys has gone in a later one."""
        for k in keys:
            rows = rows.join(self.gone().withColumnRenamed("key", k), k, "left").where("gone_at IS NULL OR version >= gone_at").drop("gone_at")
        return rows


def open_store(spark: SparkSession, path: str, version: int | None = None) -> Store:
    """The latest (or a given) version; Missing if there is none."""
    try:
        heads = spark.read.parquet(f"{path}/head")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise Missing(f"nothing is stored at {path}") from e
    row = heads.orderBy(F.desc("version")).first() if version is None else heads.where(F.col("version") == version).first()
    if row is None:
        raise Missing(f"no version {version} at {path}")
    facts = row.asDict()
    return Store(spark, path, facts.pop("version"), facts.pop("base"), facts)


def put(df: DataFrame, path: str, name: str, version: int) -> None:
    """Writes one layer; leftovers of a version that never became visible are replaced."""
    df.write.mode("overwrite").parquet(f"{path}/{name}/version={version}")


def commit(spark: SparkSession, path: str, version: int, base: int, **facts) -> Store:
    """Makes a version visible; fails if another writer was first."""
    spark.createDataFrame([(base, *facts.values())], ["base", *facts]).coalesce(1).write.mode("error").parquet(f"{path}/head/version={version}")
    return open_store(spark, path, version)
