"""Exact duplicates through content-defined chunk recipes.

A text is cut where its own content says so (a space after one of a few letters, at least
`MIN_CHUNK` characters on), so equal texts always give equal chunks. Each chunk is named by a 64-bit
hash, and a pass over the distinct chunks proves that no name stands for two different chunks; the
rare names that do are replaced by the chunks themselves. A document is then its ordered list of
chunk names, and only those short lists are grouped and joined: every chunk crosses the network
once at most, after map-side deduplication, and long texts never move as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import checkpointed, table, texts

MIN_CHUNK, MAX_CHUNK = 512, 4096
#: Cut after a space that follows one of these; without any, at MAX_CHUNK characters.
CUT_AFTER = "[dnrst.,]"
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<={CUT_AFTER}\x20)|.{{1,{MAX_CHUNK}}}"
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def collided_names(norm_docs: DataFrame, name=F.xxhash64) -> DataFrame:
    """Names that more than one distinct chunk has. Equal chunks meet before the shuffle."""
    parts = norm_docs.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    distinct = parts.select(name(F.col("chunk")).alias("name"), "chunk").groupBy("name", "chunk").agg(F.lit(1).alias("one"))
    return distinct.groupBy("name").count().where("count > 1").select("name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null text counts as empty, and all empty texts are equal. Of equal texts the smallest id stays;
    null ids are never chosen over another id. Rows that repeat an id with the same text are one document: all
    carry the same flags. Other columns of the input are not read. An empty table gives no rows.
    """
    norm = texts(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    clashes = checkpointed(collided_names(norm, name))
    recipe = F.transform(chunks(F.col("norm")), lambda c: name(c))
    sha = F.sha2(F.col("norm"), 256).alias("text_sha256")
    if clashes.isEmpty():
        rows = norm.select("doc_id", recipe.alias("recipe"), sha)
    else:  # where a name is ambiguous, the chunk itself takes its place in the list
        named = norm.withColumn("row", F.struct("doc_id", F.xxhash64("norm").alias("h"), F.length("norm").alias("n")))
        hit = (
            named.select("row", F.explode(F.array_distinct(recipe)).alias("name"))
            .join(clashes, "name", "left_semi").select("row").distinct().withColumn("hit", F.lit(True))
        )
        plain = F.transform(chunks(F.col("norm")), lambda c: name(c).cast("string"))
        rows = (
            named.join(hit, "row", "left")
            .select("doc_id", F.when(F.col("hit"), F.transform(chunks(F.col("norm")), lambda c: F.concat(F.lit("="), c))).otherwise(plain).alias("recipe"), sha)
        )
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return rows.join(groups, "recipe", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""
