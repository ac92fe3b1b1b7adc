"""Object graph by shared name parts: nodes, edges, neighbourhoods, areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import text as T

#: Two tokens are related if the shorter, of SHORTEST characters at least, starts the longer, of LONGER at least.
SHORTEST, LONGER = 3, 6


def nodes(**sources: DataFrame) -> DataFrame:
    """name, type, area, title, tokens. Sources come in order of precedence, later ones win a repeated name; nameless rows go.

    Each source has name and, where known, area, title and use_case.
    """
    out = None
    for rank, (kind, df) in enumerate(sources.items()):
        col = lambda c, df=df: F.col(c) if c in df.columns else F.lit(None).cast("string")
        part = df.where("name IS NOT NULL AND name <> ''").select(
            "name", F.lit(kind).alias("type"), F.coalesce(col("area"), F.lit("")).alias("area"), F.coalesce(T.filled(col("title")), col("use_case"), F.lit("")).alias("title"), F.lit(rank).alias("rank")
        )
        out = part if out is None else out.unionByName(part)
    top = out.groupBy("name").agg(F.max(F.struct("rank", "type", "area", "title")).alias("n"))
    return top.select("name", "n.type", "n.area", "n.title", T.name_tokens(F.col("name")).alias("tokens"))


def edges(node_table: DataFrame) -> DataFrame:
    """src, dst (both directions) of related names of different types.

    The longer token starts with the shorter, so both have the first three characters in common: an equi-join
    on these with a residual test, instead of all pairs. Tokens are joined first, once per distinct token and
    type, so that a frequent token meets each other token once and not once per name.
    """
    said = node_table.select("name", "type", F.explode("tokens").alias("token")).where(F.length("token") >= SHORTEST)
    tokens = said.select("token").distinct().withColumn("start", F.substring("token", 1, SHORTEST))
    a, b = tokens.select("start", F.col("token").alias("short")), tokens.select("start", F.col("token").alias("long"))
    related = a.join(b, "start").where((F.length("long") >= LONGER) & F.startswith("long", "short")).select("short", "long")
    left = said.select(F.col("name").alias("src"), F.col("type").alias("t1"), F.col("token").alias("short"))
    right = said.select(F.col("name").alias("dst"), F.col("type").alias("t2"), F.col("token").alias("long"))
    one = left.join(related, "short").join(right, "long").where("t1 <> t2").select("src", "dst")
    return one.union(one.select("dst", "src")).distinct()


def resolve(node_table: DataFrame, name: str) -> DataFrame:
    """One row at most: the node a name means: exact, then ignoring case, then as a prefix; the first by name."""
    low = name.lower()
    rank = F.when(F.col("name") == name, 0).when(F.lower("name") == low, 1).when(F.startswith(F.lower("name"), F.lit(low)), 2)
    return node_table.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "name").limit(1).drop("rank")


def neighbourhood(edge_table: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """root, name, hop of all nodes within `depth` hops (at least one) of each root; roots has name.

    One join and one anti join per hop; for many roots at once.
    """
    seen = roots.select(F.col("name").alias("root"), "name", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, max(depth, 1) + 1):
        step = front.join(edge_table, front["name"] == edge_table["src"]).select("root", F.col("dst").alias("name")).distinct()
        front = step.join(seen.select("root", "name"), ["root", "name"], "left_anti").withColumn("hop", F.lit(hop))
        seen = seen.unionByName(front)
    return seen.where("hop > 0")


def object_graph(node_table: DataFrame, edge_table: DataFrame, roots: DataFrame, depth: int = 1) -> DataFrame:
    """root, mode, type, name, area, title of what a root is connected with; the nodes of its area where it has no edge."""
    near = neighbourhood(edge_table, roots, depth).select("root", "name", F.lit("name_match").alias("mode"))
    alone = roots.select("name").join(edge_table.select(F.col("src").alias("name")), "name", "left_anti").join(node_table, "name").where("area <> ''")
    mates = alone.select(F.col("name").alias("root"), "area").join(node_table.select("area", "name"), "area").where("name <> root")
    found = near.unionByName(mates.select("root", "name", F.lit("area_fallback").alias("mode")))
    return found.join(node_table.select("name", "type", "area", "title"), "name").select("root", "mode", "type", "name", "area", "title")


def connection_counts(connections: DataFrame) -> DataFrame:
    """root, mode, type, n, and total over the types, of object_graph's rows. A root without any has no row: see hints."""
    n = connections.groupBy("root", "mode", "type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("root")))


def hints(node_table: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Names near one that resolve() does not find: the first ones that contain it, ignoring case, at most `most`."""
    return node_table.where(F.contains(F.lower("name"), F.lit(name.lower()))).select("name", "type").orderBy("name", "type").limit(most)


def enriched(node_table: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Nodes with live_entities (sorted, null for none): those that `entities` (service, entity) has for an API on the
    list `allowed` (service), by its name or by its name without _SRV and _PROCESS."""
    base = F.replace(F.replace("name", F.lit("_SRV"), F.lit("")), F.lit("_PROCESS"), F.lit(""))
    listed = allowed.select(F.col("service").alias("_s")).distinct()
    apis = node_table.where("type = 'api'").select("name", F.explode(F.array_distinct(F.array("name", base))).alias("_s"), base.alias("service"))
    known = apis.join(listed, "_s", "left_semi").select("name", "service").distinct()
    found = known.join(entities, "service").groupBy("name").agg(F.array_sort(F.collect_set("entity")).alias("live_entities"))
    return node_table.join(found, "name", "left")


def area_counts(node_table: DataFrame) -> DataFrame:
    """area, type, n."""
    return node_table.where("area <> ''").groupBy("area", "type").agg(F.count(F.lit(1)).alias("n"))


def area_members(node_table: DataFrame) -> DataFrame:
    """area and its member names in order, with their number."""
    return node_table.where("area <> ''").groupBy("area").agg(F.array_sort(F.collect_set("name")).alias("members")).withColumn("total", F.size("members"))


def area_map(node_table: DataFrame, area: str) -> DataFrame:
    """Members (area, type, name, title) of the area that a text means: equal ignoring case, else the first that contains it."""
    low = area.lower()
    areas = node_table.where("area <> ''").select("area").distinct()
    rank = F.when(F.lower("area") == low, 0).when(F.contains(F.lower("area"), F.lit(low)), 1)
    one = areas.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "area").limit(1).select("area")
    return node_table.join(F.broadcast(one), "area").select("area", "type", "name", "title")  # one row


def stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    """One row: nodes, edges (pairs), areas."""
    none = F.lit(0).cast("long")
    n = node_table.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct(F.nullif("area", F.lit(""))).alias("areas")).withColumn("edges", none)
    e = edge_table.where("src < dst").agg(F.count(F.lit(1)).alias("edges")).select(none.alias("nodes"), none.alias("areas"), "edges")
    return n.union(e).agg(*[F.max(c).alias(c) for c in ("nodes", "areas", "edges")])
