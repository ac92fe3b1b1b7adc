"""A TF-IDF index that is kept up to date by layers.

Stored are counts, not weights, since every weight changes with the number of documents: postings and
document frequencies of a version hold only what its documents changed. Norms depend on all
frequencies and are written anew, one number per document, from the stored counts; no text is read again.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import layers
from brindle.operators.search import SPARSE_LEAST, term_counts, with_idf
from brindle.session import stored


def _finish(spark: SparkSession, path: str, version: int, base: int, n: int) -> layers.Store:
    """Norms of all live documents, then the head. Postings are summed up where they are read; which documents are live is asked of the sums."""
    seen = layers.Store(spark, path, version, base, {"n": n})
    w = F.col("tf") / F.col("n_terms") * F.col("idf")
    weighed = with_idf(seen.table("postings"), stored(term_table(seen), "terms")).groupBy("doc_id", "version").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    layers.put(seen.still(weighed, "doc_id").select("doc_id", "norm"), path, "norms", version)
    return layers.commit(spark, path, version, base, n=n, engine="tfidf")


def _put_postings(counts: DataFrame, path: str, version: int) -> None:
    """Each file, which has all postings of some documents, in order of term, so that a query's terms reach few row groups and pages of it."""
    layers.put(counts.sortWithinPartitions("term"), path, "postings", version)


def build_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> layers.Store:
    """A first version from all documents (unique ids), or the next one, on which earlier layers no longer bear. No documents make an empty index."""
    spark = docs.sparkSession
    try:
        version = layers.open_store(spark, path).version + 1
    except layers.Missing:
        version = 1
    _put_postings(term_counts(docs, id_col, text_col), path, version)
    layers.put(docs.select(F.col(id_col).alias("doc_id")), path, "docs", version)
    now = layers.Store(spark, path, version, version, {})
    layers.put(now.table("docs").select(F.col("doc_id").alias("key")).where("false"), path, "gone", version)
    layers.put(now.table("postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")), path, "terms", version)
    return _finish(spark, path, version, version, now.table("docs").count())


def update_index(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> layers.Store:
    """The next version: `changed` documents are new or replace those with their id, `removed` (doc_id) go. Unknown ids in `removed` do no harm.

    Only postings of changed documents and the differences of the frequencies that they move are written.
    """
    old = layers.open_store(spark, path)
    version = old.version + 1
    ids = changed.select(F.col(id_col).alias("doc_id"))
    touched = (ids if removed is None else ids.union(removed.select("doc_id"))).distinct()
    layers.put(old.live("docs", "doc_id").join(touched, "doc_id", "left_semi").select(F.col("doc_id").alias("key")), path, "gone", version)
    gone = spark.read.parquet(f"{path}/gone/version={version}").withColumnRenamed("key", "doc_id")
    _put_postings(term_counts(changed, id_col, text_col), path, version)
    layers.put(ids, path, "docs", version)
    new = spark.read.parquet(f"{path}/postings/version={version}")
    less = old.live("postings", "doc_id").join(gone, "doc_id", "left_semi")
    moved = new.select("term", F.lit(1).alias("by")).union(less.select("term", F.lit(-1))).groupBy("term").agg(F.sum("by").alias("df"))
    layers.put(moved.where("df <> 0"), path, "terms", version)
    n = old.facts["n"] - gone.count() + spark.read.parquet(f"{path}/docs/version={version}").count()
    return _finish(spark, path, version, old.base, n)


def compact_index(spark: SparkSession, path: str) -> layers.Store:
    """The next version with all live rows in one layer."""
    old = layers.open_store(spark, path)
    version = old.version + 1
    _put_postings(old.live("postings", "doc_id"), path, version)
    docs = old.live("docs", "doc_id")
    layers.put(docs, path, "docs", version)
    layers.put(docs.select(F.col("doc_id").alias("key")).where("false"), path, "gone", version)
    layers.put(term_table(old).select("term", "df"), path, "terms", version)
    return _finish(spark, path, version, version, old.facts["n"])


def term_table(store: layers.Store, words: list[str] | None = None) -> DataFrame:
    """term, df and smoothed idf; of some terms only, the test then reaches the scan."""
    rows = store.table("terms") if words is None else store.table("terms").where(F.col("term").isin(words))
    df = rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    return df.withColumn("idf", F.log((F.lit(store.facts["n"]) + 1) / (F.col("df") + 1)) + 1)


def search_store(store: layers.Store, query: str, k: int = 5, least: float = SPARSE_LEAST, among: DataFrame | None = None) -> DataFrame:
    """doc_id and score of the best documents by cosine, as search.query_index has it. Only the query's terms are read of terms and postings."""
    asked = Counter(w for w in re.findall(T.TERM, query.lower()) if w not in T.STOP_WORDS)
    known = {r.term: r.idf for r in term_table(store, list(asked)).collect()} if asked else {}
    weights = {t: asked[t] * idf for t, idf in known.items()}
    length = sum(w * w for w in weights.values()) ** 0.5 or 1.0
    share = F.lit(0.0)
    for term, w in weights.items():  # a query has few words
        share = F.when(F.col("term") == term, known[term] * w / length).otherwise(share)
    # the filter comes first: it reaches the scan, and only hits meet the gone keys
    hits = store.live("postings", "doc_id").where(F.col("term").isin(list(weights)))
    if among is not None:
        hits = hits.join(among, "doc_id", "left_semi")
    raw = hits.groupBy("doc_id").agg(F.sum(F.col("tf") / F.col("n_terms") * share).alias("dot"))
    scored = raw.join(store.latest("norms"), "doc_id").select("doc_id", (F.col("dot") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("exact"))
    return scored.where(F.col("exact") >= least).select("doc_id", F.round("exact", 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def search_path(spark: SparkSession, path: str, query: str, k: int = 5, least: float = SPARSE_LEAST) -> DataFrame:
    """search_store with a column error: one row that says so, and no hit, where no index is stored."""
    try:
        return search_store(layers.open_store(spark, path), query, k, least).withColumn("error", F.lit(None).cast("string"))
    except layers.Missing as e:
        return spark.createDataFrame([(None, None, str(e))], "doc_id long, score double, error string")


def index_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: built, version, layers, documents; of a store that is not there, built is false."""
    try:
        s = layers.open_store(spark, path)
        row = (True, s.version, len(s.layer_numbers()), s.facts["n"])
    except layers.Missing:
        row = (False, None, 0, 0)
    return spark.createDataFrame([row], "built boolean, version int, layers int, documents bigint")
