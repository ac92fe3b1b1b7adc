"""From shared buckets to verified components, without expanding a group into all its pairs.

Used by both near-duplicate operators. Bands are short, so that hardly any similar pair is missed; where that
makes a bucket large, its members meet only the most central of them at first. They get a second round with longer
bands, which tell the similar from the merely related; what is then still apart in a large bucket of that round is
settled within the bucket, by bitmaps (bucket_mates), or, if it is larger than MEDIUM, by an exact join of the prefixes of their sets (apart_pairs), so that no bucket's overflow is lost. Everything here is joins and aggregations; the passes over all members are
hash aggregates of 64-bit keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import compact
from brindle.llm.components import connected_components

#: Buckets of up to so many nodes are compared pair by pair.
SMALL = 6
#: Buckets of longer bands of up to so many nodes are compared within themselves, by the nodes' bitmaps.
MEDIUM = 64
#: Words of 64 bits in a node's bitmap.
WORDS = 16
#: Filters by cell are broadcasts of so many rows at most, for any input.
CELLS = 1 << 18


def cell(key: Column) -> Column:
    return F.pmod(key, F.lit(CELLS))


def in_cells(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of `df` that may have one of the wanted 64-bit keys: a filter of bounded size ahead of an exact join."""
    cells = wanted.select(cell(F.col(key)).alias("_cell")).distinct()
    return df.join(F.broadcast(cells), cell(F.col(key)) == F.col("_cell"), "left_semi")


def bucket_pairs(members: DataFrame, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a < b), and bucket and key of the members of large buckets. `members`: key (64-bit), bucket.

    A small bucket gives all its pairs, a larger one pairs each member with the most central of them: the
    one that shares the most buckets with the most others.
    """
    tally = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.bit_xor("key").alias("odd"))
    shared = compact(tally.where("size > 1 AND lo < hi"))
    middle = F.col("odd").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    two = shared.where("size < 4").select("size", "lo", "hi", middle.alias("mid"))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    pairs = two.select(F.explode(F.when(F.col("size") == 2, F.array(pair("lo", "hi"))).otherwise(F.array(pair("lo", "hi"), pair("lo", "mid"), pair("mid", "hi")))).alias("p")).select("p.*")
    more = shared.where("size > 3").select("bucket", "size")
    met = compact(in_cells(members, "bucket", more).join(more, "bucket").select("bucket", "key", "size"))
    few, many = met.where(F.col("size") <= small), met.where(F.col("size") > small)
    x, y = (few.select("bucket", F.col("key").alias(k)) for k in "ab")
    # a key is in no more buckets than there are bands, so its window is small
    ranked = many.select("bucket", "key", F.sum("size").over(Window.partitionBy("key")).alias("weight"))
    centre = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), "key")).alias("first")).select("bucket", F.col("first.key").alias("centre"))
    star = many.join(centre, "bucket").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b"))
    return compact(pairs.union(x.join(y, "bucket").select("a", "b")).union(star).where("a < b").distinct()), many.select("bucket", "key")


def apart_members(many: DataFrame, keyed: DataFrame, comp: DataFrame) -> DataFrame:
    """The members (bucket, node, part, members) of the large buckets that hold more than one component, and how many each has. `keyed`: key, node."""
    placed = compact(many.join(keyed, "key").join(comp, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part")))
    parts = placed.select("bucket", F.xxhash64("part").alias("h")).groupBy("bucket").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("members"))
    return compact(placed.join(parts.where("lo < hi").select("bucket", "members"), "bucket"))


def bitmaps(items: DataFrame) -> DataFrame:
    """node and b0, b1, ...: a bit for each of its tokens. A bit that only one of two nodes has stands for a token that only this one has."""
    word, bit = F.pmod(F.col("token"), F.lit(WORDS)), F.expr("shiftleft(1L, CAST(pmod(shiftright(token, 8), 64) AS INT))")
    return items.groupBy("node").agg(*[F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"b{k}") for k in range(WORDS)])


def only_in(a: str, b: str) -> Column:
    """Number of bits of the one bitmap that the other lacks: at least so many tokens are in the one set only."""
    return sum((F.bit_count(F.col(f"b{k}_{a}").bitwiseAND(F.bitwise_not(F.col(f"b{k}_{b}")))) for k in range(1, WORDS)), F.bit_count(F.col(f"b0_{a}").bitwiseAND(F.bitwise_not(F.col(f"b0_{b}")))))


def alike_enough(similarity: float, sized: bool) -> Column:
    """What sizes (n, total) and bitmaps of x and y leave possible; see apart_pairs for the bounds."""
    sizes, own = F.col("n_x") + F.col("n_y"), {"x": only_in("x", "y"), "y": only_in("y", "x")}
    possible = (F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y") - 1e-6) & (own["x"] + own["y"] <= (1 - similarity) / (1 + similarity) * sizes + 1e-6)
    if sized:
        return possible
    rest = lambda k: (1 - own[k] / F.col(f"total_{k}")) / (1 + own[k] / F.col(f"total_{k}"))
    return possible | ((rest("x") + rest("y")) / 2 >= similarity - 1e-6)


def bucket_mates(members: DataFrame, items: DataFrame, similarity: float, sized: bool) -> DataFrame:
    """Every pair (a < b) of keys in one bucket but different components that may reach the similarity. `members`: bucket, node, part
    (the buckets of bounded size); `items`: node, token, weight of the nodes' whole sets."""
    known = bitmaps(items).join(items.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total")), "node")
    bits = [f"b{k}" for k in range(WORDS)]
    met = members.join(known, "node").select("bucket", F.xxhash64("node").alias("key"), F.xxhash64("part").alias("part"), "n", "total", *bits)
    x, y = (met.select("bucket", *[F.col(c).alias(f"{c}_{k}") for c in ("key", "part", "n", "total", *bits)]) for k in "xy")
    both = x.join(y, "bucket").where("part_x < part_y").where(alike_enough(similarity, sized))
    return both.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def apart_pairs(items: DataFrame, apart: DataFrame, similarity: float, sized: bool) -> DataFrame:
    """Every pair (a < b) of nodes in different components that may reach the similarity. `items`: node, token, weight of whole sets;
    `apart`: node, part (its component).

    With all tokens in one order, rare ones first, two sets of (set or probability) Jaccard s share a token among
    the first of each: those that more than s of its tokens, or more than s of its weight, do not follow. (Neither
    Jaccard exceeds the share of tokens, or of normalised weight, that the two have in common.) Nor can
    two be alike whose first shared token comes too late for the rest to suffice, or (set Jaccard) that differ too
    much in size. With the normalised weights p and q before that token, the probability Jaccard is at most the mean
    of (1 - p) / (1 + p) and (1 - q) / (1 + q): these weights are in one of the two only, so each term of the sum is
    at most the harmonic mean of its weight / (1 + p) and / (1 + q). The same bounds hold for what the bitmaps tell of tokens (of
    weight 1 at least) that only one of the two has: related sets that are not alike seldom become a row of the join. `sized`: set Jaccard only. A token whose
    nodes are all of one component is dropped.
    """
    items = items.repartition("token")
    often = items.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    whole = Window.partitionBy("node")
    order = whole.orderBy("often", "token")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = items.join(often, "token").select(
        "node", "token", "often", F.row_number().over(order).alias("rank"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("mass"),
        F.count(F.lit(1)).over(whole).alias("n"), F.sum("weight").over(whole).alias("total"),
    )
    slack = 1 - similarity
    first = ranked.where("often > 1").where((F.col("rank") - 1 <= slack * F.col("n") + 1e-6) | (F.col("mass") <= slack * F.col("total") + 1e-6))
    bits = [f"b{k}" for k in range(WORDS)]
    known = apart.join(bitmaps(items), "node")
    placed = compact(first.join(known, "node").select("token", "node", "n", "rank", "total", (F.col("mass") / F.col("total")).alias("before"), "part", F.xxhash64("part").alias("h"), *bits))
    mixed = placed.groupBy("token").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo < hi").select("token")
    met = compact(placed.join(mixed, "token", "left_semi"))
    x, y = (met.select("token", *[F.col(c).alias(f"{c}_{k}") for c in ("node", "n", "rank", "total", "before", "part", *bits)]) for k in "xy")
    both = x.join(y, "token").where("part_x < part_y")
    sizes = F.col("n_x") + F.col("n_y")
    enough = similarity / (1 + similarity) * sizes - 1e-6  # shared tokens of such a pair
    left = 1 + F.least(F.col("n_x") - F.col("rank_x"), F.col("n_y") - F.col("rank_y"))
    own = {"x": only_in("x", "y"), "y": only_in("y", "x")}
    alike = own["x"] + own["y"] <= (1 - similarity) / (1 + similarity) * sizes + 1e-6
    possible = (F.least("n_x", "n_y") >= similarity * F.greatest("n_x", "n_y") - 1e-6) & (left >= enough) & alike
    if not sized:
        rest = lambda m: (1 - m) / (1 + m)
        enough_mass = lambda of: (rest(of("x")) + rest(of("y"))) / 2 >= similarity - 1e-6
        possible = possible | (enough_mass(lambda k: F.col(f"before_{k}")) & enough_mass(lambda k: own[k] / F.col(f"total_{k}")))
    both = both.where(possible)
    return both.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct()


def whole_components(
    links: DataFrame, many: DataFrame, keyed: DataFrame, again: Callable[[DataFrame], DataFrame], items_of: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame], similarity: float, sized: bool = False,
) -> DataFrame:
    """Components (node, component) of the links and of the verified pairs among the members of large buckets.

    `many`: bucket and key of those members; `keyed`: key and node; `again` gives the second round's key and bucket
    of such keys, `items_of` the items of such nodes; `verify` gives the links of pairs of keys.
    """
    if not many.take(1):
        return connected_components(links)
    pairs, many = bucket_pairs(compact(again(many.select("key").distinct())))
    comp = connected_components(links.union(verify(pairs)))
    apart = apart_members(many, keyed, comp)
    if not apart.take(1):
        return comp
    medium, large = apart.where(F.col("members") <= MEDIUM), compact(apart.where(F.col("members") > MEDIUM).select("node", "part").distinct())
    found = bucket_mates(medium.select("bucket", "node", "part"), items_of(medium), similarity, sized)
    if large.take(1):
        found = found.union(apart_pairs(items_of(large), large, similarity, sized).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))).distinct()
    more = compact(verify(compact(found)))
    return connected_components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)) if more.take(1) else comp
