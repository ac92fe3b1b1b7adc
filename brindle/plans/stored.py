"""Registered queries over stores that are built, changed and then read: index, graph and dense vectors.

The first version of a store holds the driver's rows with some missing, some other and some too many; a change
then makes it what the driver's tables say, so that every answer equals that of a full rebuild.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph, layers, stored_graph, stored_index, stored_vectors
from brindle.plans import catalog
from brindle.plans.catalog import registered
from brindle.session import scratch, table


def _changed_index(spark: SparkSession, sf_dir: str) -> layers.Store:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, stale, k = scratch(spark, "index"), F.col("doc_id") % 8 == 0, F.col("doc_id") % 8 < 2
    before = docs.where(~k).union(docs.where(stale).select("doc_id", F.concat_ws(" ", F.lit("stale"), "text"))).union(docs.where(stale).select(-1 - F.col("doc_id"), "text"))
    stored_index.build_index(before, path)
    return stored_index.update_index(spark, path, docs.where(k), docs.where(stale).select((-1 - F.col("doc_id")).alias("doc_id")))


@registered(catalog.SQL["term_df_idf"])
def stored_index_terms(spark, sf_dir):
    """Document frequencies after a change of a quarter of the documents."""
    return stored_index.term_table(_changed_index(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


@registered(catalog.SQL["tfidf_topk"])
def stored_index_topk(spark, sf_dir):
    return stored_index.search_store(_changed_index(spark, sf_dir), catalog.QUERY_WORDS, 10)


def _changed_graph(spark: SparkSession, sf_dir: str) -> layers.Store:
    nodes = graph.nodes(**{k: df.drop("replaces") for k, df in catalog.objects(spark, sf_dir).items()})
    path, part = scratch(spark, "graph"), F.pmod(F.hash("name"), F.lit(5))
    extra = nodes.where(part == 0).withColumn("name", F.concat(F.lit("EXTRA_"), "name"))
    other = nodes.where(part == 1).withColumn("type", F.lit("view"))
    stored_graph.write_graph(nodes.where(part > 1).unionByName(other).unionByName(extra), path)
    return stored_graph.update_graph(spark, path, nodes.where(part <= 1), extra.select("name"))


@registered(catalog.SQL["name_token_edges"])
def stored_graph_edges(spark, sf_dir):
    """All edges after a change of two fifths of the nodes."""
    return stored_graph.live_edges(_changed_graph(spark, sf_dir))


@registered(catalog.SQL["graph_bfs_depth2"])
def stored_graph_bfs(spark, sf_dir):
    store = _changed_graph(spark, sf_dir)
    return stored_graph.walk(store, stored_graph.live_nodes(store).where("name LIKE 'MM\\_%'").select("name"), 2)


@registered(catalog.SQL["graph_stats"])
def stored_graph_status(spark, sf_dir):
    return stored_graph.graph_status(spark, _changed_graph(spark, sf_dir).path).select("nodes", "areas", "edges")


# ---------------------------------------------------------------- dense vectors

NEAREST = 10
def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100, against all."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 100 == 0)


@registered(f"""
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT q.vec_id AS id, u.vec_id AS hit, round(list_dot_product(q.v, u.v) / (q.n * u.n), 6) AS score FROM u AS q, u WHERE q.vec_id % 100 = 0),
r AS (SELECT id, hit, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, hit) AS place FROM s)
SELECT id, hit, place::INT AS place, score FROM r WHERE place <= {NEAREST}""")
def vector_neighbours(spark, sf_dir):
    """The best matches of each query, exactly: the stored index with all cells probed."""
    store = stored_vectors.build_vectors(table(spark, sf_dir, "embeddings"), scratch(spark, "vectors"))
    return stored_vectors.search_vectors(store, _asked(spark, sf_dir), NEAREST, None, -2.0)


@registered(f"SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, {NEAREST} * count(*) FILTER (vec_id % 100 = 0) AS exact, true AS enough FROM embeddings")
def vector_recall(spark, sf_dir):
    """Whether the probing search finds 0.95 of the exact best matches of all queries."""
    store = stored_vectors.build_vectors(table(spark, sf_dir, "embeddings"), scratch(spark, "vectors"), recall=0.97)
    return stored_vectors.recall_of(store, _asked(spark, sf_dir), NEAREST).select("queries", "exact", (F.col("recall") >= 0.95).alias("enough"))
