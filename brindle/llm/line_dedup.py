"""Fuzzy line deduplication by MinHash, in DataFrame and SQL functions only.

A line (normalised: lower case, single spaces, trimmed) is a node named by its md5. Its shingles are all its runs
of SHINGLE characters, at every position (a shorter line is one shingle), whatever its script or length. They are
hashed once; in the circle of hash values, band k of the signature is the first three distinct hashes among those
that follow point k, so two lines share a band with about the cube of their Jaccard. Bands give candidates, whose exact Jaccard is
then computed from the whole sets. Equal and verified lines form components by distributed union-find, and of each
component the first line, by (doc_id, text, line number), stays. Large buckets are not expanded into pairs; the
components of their members are completed by an exact join (see candidates).

Blank lines always stay. A document row is known by its doc_id and its text, so rows that repeat both are one
document, and rows that repeat only the id are not confused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.candidates import bucket_pairs, in_cells, whole_components
from brindle.llm.common import compact, scratch, table

SHINGLE, SIMILARITY = 10, 0.8
#: A pair of Jaccard 0.8 shares one of the bands with probability 0.997, of 0.85 with 0.9995.
BANDS, ROWS = 8, 3
#: Second round, for lines of unsettled large buckets: 0.9993 at 0.8, but 0.02 at 0.3.
LONG_BANDS, LONG_ROWS = 24, 6
WHITE = ("\t", "\r", "\v", "\f", "  ")


def normalised(text: Column) -> Column:
    """Lower case, runs of white space in a line as one space; line feeds stay."""
    odd = F.lit(False)
    for w in WHITE:
        odd = odd | F.contains(text, F.lit(w))
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\x20\t\r\f\x0B]+", " ")).otherwise(text))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark, line (number from 0), norm and node of every line that is not blank. `docs` has doc_id, mark and text.

    (The outer form of explode keeps Spark from splitting once more, only to test for emptiness.)
    """
    rows = docs.select("doc_id", "mark", F.posexplode_outer(F.split(normalised(F.col("text")), "\n", -1)).alias("line", "raw"))
    return rows.select("doc_id", "mark", "line", F.trim("raw").alias("norm")).where("norm <> ''").withColumn("node", F.unhex(F.md5("norm")))


def shingle_hashes(norm: Column) -> Column:
    """Hashes of the shingles, in order.

    In UTF-32 every character has four bytes, so a shingle is cut out in constant time. (The text is bound to a
    lambda variable, since a column of bytes would be copied at each use.)
    """
    width = 4 * SHINGLE
    starts = lambda b: F.sequence(F.lit(1), F.greatest(F.octet_length(b) - (width - 1), F.lit(1)), F.lit(4))
    found = F.transform(F.array(F.encode(norm, "UTF-32")), lambda b: F.transform(starts(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(width)))))
    return F.element_at(found, 1)


def banded(rows: DataFrame, bands: int = BANDS, width: int = ROWS) -> DataFrame:
    """Replaces the hashes `h` (one at least) by `size`, the number of distinct ones, and `buckets`, one 64-bit key per band.

    Band k takes the first `width` distinct hashes after point k (from the end on to the beginning). The points at
    which bands begin are sorted into the hashes to find how many of these are before each.
    """
    rest = [c for c in rows.columns if c != "h"]
    points = [(2 * k + 1) * (1 << 64) // (2 * bands) - (1 << 63) for k in range(bands)]
    hashes = rows.select(*rest, F.sort_array(F.array_distinct("h")).alias("h"))
    ring = hashes.select(*rest, F.size("h").alias("size"), F.concat("h", F.slice("h", 1, width)).alias("round"), F.sort_array(F.concat("h", F.array(*map(F.lit, points)))).alias("ring"))
    after = lambda k, p: F.slice("round", F.array_position("ring", F.lit(p)).cast("int") - F.lit(k), F.lit(width))
    keys = F.array(*[F.xxhash64(F.lit(k), after(k, p)) for k, p in enumerate(points)])
    # a higher-order function (here of nothing) makes Spark compile each key by itself; all in one are too large for the JIT
    return ring.select(*rest, "size", F.concat(keys, F.transform(F.slice("ring", 1, 0), lambda x: x)).alias("buckets"))


def close(a: str, b: str, similarity: float) -> Column:
    """Sets of sizes a and b may have this Jaccard."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-9


def verified(pairs: DataFrame, norms: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of each pair of keys whose exact Jaccard reaches the threshold. `norms`: key, node, norm, n (distinct shingles).

    Sets of too different sizes are not compared."""
    a, b = (norms.select(F.col("key").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("node", "norm", "n")]) for k in "ab")
    both = pairs.join(a, "a").join(b, "b").where(close("n_a", "n_b", similarity)).select("node_a", "node_b", (F.col("n_a") + F.col("n_b")).alias("n"), shingle_hashes(F.col("norm_a")).alias("sa"), shingle_hashes(F.col("norm_b")).alias("sb"))
    sized = both.select("node_a", "node_b", "n", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    return sized.where(F.col("shared") >= similarity * (F.col("n") - F.col("shared")) - 1e-9).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of the text) and text of each row that has both."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def dropped_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark and line number of each line that an earlier line makes superfluous, with the place of the one
    that stays (keep_id, keep_line). Null and empty texts have no lines, rows without doc_id are left alone, other
    columns are not read, and an empty table gives no rows."""
    spark = docs.sparkSession
    rows = marked(docs, id_col, text_col)
    path = scratch(spark, "lines")
    lines = lines_of(rows).select("node", F.struct("doc_id", "mark", "line").alias("place"), shingle_hashes(F.col("norm")).alias("h"))
    banded(lines).groupBy("node").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("buckets").alias("buckets")).write.parquet(path)
    nodes = spark.read.parquet(path).withColumn("key", F.xxhash64("node"))
    pairs, many = bucket_pairs(nodes.select("key", F.explode_outer("buckets").alias("bucket")))
    ends = lambda of: of.select(F.col("a").alias("key")).union(of.select("b"))
    met = ends(pairs).distinct()
    met = compact(in_cells(nodes.select("key", "node", "size", "first.*"), "key", met).join(met, "key", "left_semi"))
    a, b = (met.select(F.col("key").alias(k), F.col("size").alias(f"size_{k}")) for k in "ab")
    pairs = compact(pairs.join(a, "a").join(b, "b").where(close("size_a", "size_b", similarity)).select("a", "b"))
    wanted = compact(met.join(ends(pairs).union(many.select("key")).distinct(), "key", "left_semi"))
    # a line's text comes from the first document that has it; few other documents are split once more
    texts = in_cells(lines_of(in_cells(rows, "mark", wanted)).withColumn("key", F.xxhash64("node")), "key", wanted)
    norms = compact(texts.join(wanted, ["key", "node", "doc_id", "mark", "line"]).dropDuplicates(["node"]).select("key", "node", "norm", F.col("size").alias("n")))
    links = compact(verified(pairs, norms, similarity))
    of = lambda few: norms.join(few, "node", "left_semi")
    again = lambda few: banded(norms.join(few, "key", "left_semi").select("key", shingle_hashes(F.col("norm")).alias("h")), LONG_BANDS, LONG_ROWS).select("key", F.explode_outer("buckets").alias("bucket"))
    items = lambda few: of(few).select("node", F.explode(F.array_distinct(shingle_hashes(F.col("norm")))).alias("token"), F.lit(1).alias("weight"))
    comp = whole_components(links, many, norms.select("key", "node"), again, items, lambda found: verified(found, norms, similarity), similarity, sized=True)
    joined = nodes.select("node", "first", "n").join(comp, "node", "left").where("component IS NOT NULL OR n > 1")
    keep = joined.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("keep"))
    copies = compact(joined.join(keep, "component", "left").select("node", F.coalesce("keep", "first").alias("keep")))
    placed = lines_of(rows).select("node", "doc_id", "mark", "line").join(copies, "node")
    return placed.where(F.struct("doc_id", "mark", "line") != F.col("keep")).select("doc_id", "mark", "line", F.col("keep.doc_id").alias("keep_id"), F.col("keep.line").alias("keep_line"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns (any names), texts without their dropped lines.

    A document that loses all its lines goes; one that had none to begin with (null, empty or blank), or has no
    doc_id, stays. Rows that repeat a doc_id with another text are documents of their own; rows that repeat both
    are one document, in which no line is superfluous because of the other row. An empty table stays empty.
    """
    gone = dropped_lines(docs, similarity).groupBy("doc_id", "mark").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "gone")
    whole = docs.select(F.struct("*").alias("row"), F.split(F.col("text").cast("string"), "\n", -1).alias("lines"))
    cut = whole.join(gone, (F.col("row.doc_id") == F.col("gone_id")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("gone_mark")), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = cut.select("row", F.when(F.col("gone").isNotNull(), F.transform(left, lambda i: F.get("lines", i))).alias("kept"))
    stay = kept.where("kept IS NULL OR exists(kept, x -> trim(x) <> '')")
    text = F.when(F.col("kept").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    return stay.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its number of lines, the numbers of those that go, and where each one's kept line is."""
    docs = table(spark, sf_dir, "documents")
    gone = dropped_lines(docs).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(F.struct("line", "keep_id", "keep_line"))).alias("gone"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast(gone.schema["gone"].dataType)
    joined = rows.join(gone, ["doc_id", "mark"], "left").withColumn("gone", F.coalesce("gone", none)).withColumn("n_dropped", F.size("gone").cast("long"))
    return joined.select("doc_id", "n_lines", "n_dropped", F.transform("gone", lambda g: g["line"]).alias("dropped"), F.transform("gone", lambda g: g["keep_id"]).alias("keep_ids"), F.transform("gone", lambda g: g["keep_line"]).alias("keep_lines"))
