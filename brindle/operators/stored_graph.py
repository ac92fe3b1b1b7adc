"""A stored object graph whose edges are bucketed by their source.

A hop of a walk then shuffles only its front: every layer of edges is read in buckets, in the partitioning that the join
needs. A change of nodes writes a layer with the edges of these nodes and lists their names as gone (see
layers); edges of other nodes are not computed or written again.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import graph, layers

BUCKETS = 16


def _edge_table(store: layers.Store, version: int) -> DataFrame:
    """The edges of one layer as a bucketed table; this session's catalog is told where it lies."""
    buckets, folder = store.facts["buckets"], f"{store.path}/edges/version={version}"
    name = f"edges_{hashlib.md5(folder.encode()).hexdigest()}"
    store.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (src STRING, dst STRING) USING parquet CLUSTERED BY (src) SORTED BY (src) INTO {int(buckets)} BUCKETS LOCATION '{folder}'")
    return store.spark.table(name)


def _put_edges(edges: DataFrame, path: str, version: int, buckets: int) -> None:
    folder = f"{path}/edges/version={version}"
    name = f"edges_{hashlib.md5(folder.encode()).hexdigest()}"
    edges.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")  # an external table: its files are replaced by the next line
    edges.select("src", "dst").repartition(buckets, "src").write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").option("path", folder).saveAsTable(name)


def _commit(spark: SparkSession, path: str, version: int, base: int, buckets: int) -> layers.Store:
    now = layers.Store(spark, path, version, base, {"buckets": buckets})
    s = graph.stats(live_nodes(now), live_edges(now)).first()
    return layers.commit(spark, path, version, base, buckets=buckets, nodes=s.nodes, edges=s.edges, areas=s.areas)


def live_nodes(store: layers.Store) -> DataFrame:
    return store.live("nodes", "name")


def live_edges(store: layers.Store) -> DataFrame:
    """src and dst of all edges that hold."""
    rows = reduce(DataFrame.unionByName, [_edge_table(store, v).withColumn("version", F.lit(v)) for v in store.layer_numbers()])
    return _holding(store, rows).select("src", "dst")


def _holding(store: layers.Store, rows: DataFrame) -> DataFrame:
    """Rows with src, dst and version neither of whose ends has gone since."""
    if store.version == store.base:
        return rows
    for end in ("src", "dst"):
        rows = rows.join(store.gone().withColumnRenamed("key", end), end, "left").where("gone_at IS NULL OR version >= gone_at").drop("gone_at")
    return rows


def write_graph(nodes: DataFrame, path: str, buckets: int = BUCKETS) -> layers.Store:
    """Stores the graph of all nodes (of graph.nodes) as a new base version. `head` has its numbers of nodes, edges (pairs) and areas."""
    spark = nodes.sparkSession
    try:
        version = layers.open_store(spark, path).version + 1
    except layers.Missing:
        version = 1
    layers.put(nodes, path, "nodes", version)
    stored = spark.read.parquet(f"{path}/nodes/version={version}")
    layers.put(stored.select(F.col("name").alias("key")).where("false"), path, "gone", version)
    _put_edges(graph.edges(stored), path, version, buckets)
    return _commit(spark, path, version, version, buckets)


def edges_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """src (of left) and dst (of right) of related names of different types, as graph.edges has it, in one direction."""
    said = lambda df: df.select("name", "type", F.explode("tokens").alias("token")).where(F.length("token") >= graph.SHORTEST)
    a, b = said(left), said(right)
    start = F.substring("token", 1, graph.SHORTEST).alias("start")
    ta, tb = a.select(start, F.col("token").alias("x")).distinct(), b.select(start, F.col("token").alias("y")).distinct()
    starts = lambda long, short: (F.length(long) >= graph.LONGER) & F.startswith(long, short)
    related = ta.join(tb, "start").where(starts(F.col("x"), F.col("y")) | starts(F.col("y"), F.col("x"))).select("x", "y")
    p = a.select(F.col("name").alias("src"), F.col("type").alias("t1"), F.col("token").alias("x"))
    q = b.select(F.col("name").alias("dst"), F.col("type").alias("t2"), F.col("token").alias("y"))
    return p.join(related, "x").join(q, "y").where("t1 <> t2").select("src", "dst").distinct()


def update_graph(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None) -> layers.Store:
    """The next version: `changed` nodes (as of graph.nodes) are new or replace those with their name, `removed` (name) go."""
    old = layers.open_store(spark, path)
    version, buckets = old.version + 1, old.facts["buckets"]
    names = changed.select("name")
    touched = (names if removed is None else names.union(removed.select("name"))).distinct()
    kept = live_nodes(old)
    layers.put(kept.join(touched, "name", "left_semi").select(F.col("name").alias("key")), path, "gone", version)
    layers.put(changed.select(*kept.columns), path, "nodes", version)
    new = spark.read.parquet(f"{path}/nodes/version={version}")
    others = kept.join(touched, "name", "left_anti")
    one = edges_between(new, others)
    _put_edges(one.union(one.select("dst", "src")).union(edges_between(new, new)), path, version, buckets)
    return _commit(spark, path, version, old.base, buckets)


def walk(store: layers.Store, roots: DataFrame, depth: int = 1) -> DataFrame:
    """root, name, hop of all nodes within `depth` hops of each root, as graph.neighbourhood has it. The edges of a layer are not shuffled:
    the front is dealt out as their buckets are."""
    seen = roots.select(F.col("name").alias("root"), "name", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, max(depth, 1) + 1):
        dealt = front.select("root", F.col("name").alias("src")).repartition(store.facts["buckets"], "src")
        steps = [dealt.hint("shuffle_hash").join(_edge_table(store, v).hint("merge"), "src").withColumn("version", F.lit(v)) for v in store.layer_numbers()]
        step = _holding(store, reduce(DataFrame.unionByName, steps)).select("root", F.col("dst").alias("name")).distinct()
        front = step.join(seen.select("root", "name"), ["root", "name"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def walk_path(spark: SparkSession, path: str, roots: DataFrame, depth: int = 1) -> DataFrame:
    """walk with a column error: one row that says so where no graph is stored."""
    try:
        return walk(layers.open_store(spark, path), roots, depth).withColumn("error", F.lit(None).cast("string"))
    except layers.Missing as e:
        return spark.createDataFrame([(None, None, None, str(e))], "root string, name string, hop int, error string")


def neighbours(store: layers.Store, name: str, depth: int = 1) -> DataFrame:
    """The whole answer about one object, in long rows: part, type, name, area, title.

    part is `root` (the node that the name means), `name_match` or, for a node without edges, `area_fallback`; of a name that is not found
    it is `hint` (first names that contain it) and `area` (all areas).
    """
    nodes = live_nodes(store)
    root = graph.resolve(nodes, name).select("name", "type", "area", "title")
    row = root.first()
    if row is None:
        none = F.lit(None).cast("string")
        areas = nodes.where("area <> ''").select("area").distinct()
        return graph.hints(nodes, name).select(F.lit("hint").alias("part"), "type", "name", none.alias("area"), none.alias("title")).unionByName(
            areas.select(F.lit("area").alias("part"), none.alias("type"), none.alias("name"), "area", none.alias("title"))
        )
    near = walk(store, root.select("name"), depth).select("name", F.lit("name_match").alias("part"))
    found = near
    if row.area and near.isEmpty():
        found = nodes.where((F.col("area") == row.area) & (F.col("name") != row.name)).select("name", F.lit("area_fallback").alias("part"))
    rest = found.join(nodes, "name").select("part", "type", "name", "area", "title")
    return root.select(F.lit("root").alias("part"), "type", "name", "area", "title").unionByName(rest)


def graph_status(spark: SparkSession, path: str) -> DataFrame:
    """One row: built, version, layers, nodes, edges, areas, from the head alone: no graph is read."""
    try:
        s = layers.open_store(spark, path)
        row = (True, s.version, len(s.layer_numbers()), s.facts["nodes"], s.facts["edges"], s.facts["areas"])
    except layers.Missing:
        row = (False, None, 0, 0, 0, 0)
    return spark.createDataFrame([row], "built boolean, version int, layers int, nodes bigint, edges bigint, areas bigint")
