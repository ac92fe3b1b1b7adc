"""JSON files, run manifests, logs and markdown inputs as DataFrames; sinks for tables and logs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from brindle.functions import text as T
from brindle.operators import manifests
from brindle.operators.runs import titled

SAFE_NAME = r"[A-Za-z0-9._ -]+"


def scan_ordered(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A stored table in order of its key."""
    return spark.read.parquet(path).orderBy(key)


def lookup(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows with one key; the test reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col(key) == value)


def read_json_files(spark: SparkSession, path: str, schema: ty.StructType) -> DataFrame:
    """One row per JSON document; an unreadable file gives a row of nulls."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def salvage_json(text: Column) -> Column:
    """The first complete JSON value of a text, whatever follows it; null without any."""

    def first(s: str | None) -> str | None:
        try:
            return json.dumps(json.JSONDecoder().raw_decode((s or "").lstrip("\ufeff \t\r\n"))[0])
        except ValueError:
            return None

    whole = F.try_parse_json(text).isNotNull()
    return F.coalesce(F.when(whole, text), F.udf(first, "string", useArrow=True)(F.when(~whole, text)))  # only broken texts go to Python


def read_manifests(spark: SparkSession, root: str, pattern: str = "run.json") -> DataFrame:
    """path, folder and body (first complete JSON value) of every manifest below a folder, each once."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), "value").dropDuplicates(["path"])
    return rows.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), salvage_json(F.col("value")).alias("body"))


def read_runs(spark: SparkSession, root: str, contract: dict[str, dict[str, str]]) -> DataFrame:
    """Runs below a folder (one folder each, with run.json) with all that manifests.run_rows derives."""
    listed = spark.read.format("binaryFile").load(f"{root}/*/*").select("path")  # names only: no content is read
    files = listed.select(F.element_at(F.split("path", "/"), -2).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"))
    bodies = read_texts(spark, f"{root}/*/run.json").select(F.element_at(F.split("path", "/"), -2).alias("folder"), salvage_json(F.col("value")).alias("body"))
    return manifests.run_rows(bodies, contract, files)


def read_run_file(spark: SparkSession, root: str, run: str, name: str) -> DataFrame:
    """value: the text of one file of a run. Both names are plain, so nothing outside the run's folder can be named."""
    for part in (run, name):
        if not re.fullmatch(SAFE_NAME, part or "") or set(part) <= {".", " "}:
            raise ValueError(f"invalid name: {part!r}")
    return spark.read.text(f"{root}/{run}/{name}", wholetext=True)


def size_kb(text: Column) -> Column:
    return F.round(F.length(text) / 1024, 1)


def skill_rows(files: DataFrame) -> DataFrame:
    """name (the folder), description (the first such line of the head), size_kb, path and content of skill files (path, value)."""
    found = F.regexp_extract("value", r"(?m)^description:\s*(.+)$", 1)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.trim(found).alias("description"), size_kb(F.col("value")).alias("size_kb"), "path", F.col("value").alias("content"))


def workflow_rows(files: DataFrame) -> DataFrame:
    """file, title (a heading at the very start, else the file's name), type by the file's name, description (the line named Realization, else
    Skill, without quotes and stars), size_kb and content of workflow files (path, value)."""
    file = F.element_at(F.split("path", "/"), -1)
    line = lambda name: T.filled(F.regexp_extract("value", rf"\*\*{name}:\*\*\s*(.+)", 1))
    title = T.filled(F.regexp_extract("value", r"\A#\s*(.+)", 1))
    return files.select(
        file.alias("file"), F.coalesce(title, F.regexp_replace(file, r"\.md$", "")).alias("title"), F.when(F.upper(file).startswith("RICEFW"), "RICEFW").otherwise("Process").alias("type"),
        F.trim(F.regexp_replace(F.coalesce(line("Realization"), line("Skill"), F.lit("")), "[`*]", "")).alias("description"), size_kb(F.col("value")).alias("size_kb"), F.col("value").alias("content"),
    )


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """path and value (whole) of the files that a path pattern names, such as skills/*/SKILL.md or workflows/*.md; empty files have no row."""
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a bad line is left out, and only that line (a sequential reader would stop there)."""
    bad = "_bad_line"
    rows = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    return rows.where(F.col(bad).isNull()).drop(bad)


def last_result(lines: DataFrame, group: str, order: str, text_col: str = "value") -> DataFrame:
    """Of each group the last line whose JSON type is `result`."""
    v = F.try_parse_json(F.col(text_col))
    rows = lines.where(F.try_variant_get(v, "$.type", "string") == "result")
    return rows.groupBy(group).agg(F.max_by(text_col, order).alias("result"))


def read_inputs(spark: SparkSession, root: str) -> DataFrame:
    """path, title (first heading, else the file name) and size of markdown and text inputs."""
    raw = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), "value").where(F.col("path").rlike(r"(?i)\.(md|txt)$"))
    return rows.select("path", F.coalesce(titled(F.col("value")), F.element_at(F.split("path", "/"), -1)).alias("title"), "size")


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrites a stored table; `df` must not read from it. The old files go before the new ones are committed, so
    a failed job leaves no table: a reader that must never miss one reads a snapshot (see write_snapshot)."""
    df.write.mode("overwrite").parquet(path)


def write_snapshot(df: DataFrame, path: str, version: str) -> str:
    """Writes a table under a new version of `path` and returns its folder; earlier ones stay as they are, and `df` may read them."""
    df.write.mode("error").parquet(folder := f"{path}/version={version}")
    return folder


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a table (by its name); only that folder is read. Files of a failed write are not yet in place."""
    every = spark.read.option("basePath", path).parquet(path).withColumn("version", F.col("version").cast("string"))
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0]).drop("version")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
