"""The stored graph against the one computed from all nodes, and the shape of its plans."""

import random

import pytest

from brindle.operators import graph, layers, stored_graph

WORDS = "sales salesorder order orderitem purchase material materialplant plant stock invoice".split()


def source(spark, rows):
    return spark.createDataFrame(rows, "name string, area string, title string")


def catalog(spark, seed, n=30):
    rng = random.Random(seed)
    name = lambda: "".join(w.capitalize() for w in rng.sample(WORDS, rng.randint(1, 2)))
    rows = lambda p: [(f"{p}{name()}", rng.choice(["A", "B", ""]), "t") for _ in range(n)] + [(f"{p}Qqq{p[:1]}", "A", "")]
    return graph.nodes(api=source(spark, rows("API_")), view=source(spark, rows("I_")))


def pairs(df):
    return sorted((r.src, r.dst) for r in df.collect())


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A graph after two changes, and the nodes it should have."""
    path = str(tmp_path_factory.mktemp("graph") / "g")
    first = catalog(spark, 1).cache()
    stored_graph.write_graph(first, path, 4)
    now = first
    for seed, gone in ((2, 3), (3, 5)):
        changed = catalog(spark, seed, 6).cache()
        names = sorted(r.name for r in now.collect())
        removed = spark.createDataFrame([(x,) for x in [*random.Random(seed).sample(names, gone), "no such name"]], "name string")
        removed = removed.join(changed, "name", "left_anti")
        store = stored_graph.update_graph(spark, path, changed, removed)
        left = now.join(changed, "name", "left_anti").join(removed, "name", "left_anti").unionByName(changed)
        now = spark.createDataFrame(left.collect(), now.schema)
    return store, now


def test_delta_equals_rebuild(spark, stored):
    store, now = stored
    assert sorted(map(tuple, stored_graph.live_nodes(store).select(*now.columns).collect())) == sorted(map(tuple, now.collect()))
    want = pairs(graph.edges(now))
    assert pairs(stored_graph.live_edges(store)) == want and want
    assert all((b, a) in set(want) for a, b in want)
    s = graph.stats(now, graph.edges(now)).first()
    assert [tuple(r) for r in stored_graph.graph_status(spark, store.path).collect()] == [(True, 3, 3, s.nodes, s.edges, s.areas)]


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_walk_equals_neighbourhood(stored, depth):
    store, now = stored
    roots = now.where("type = 'api'").select("name")
    triples = lambda df: sorted((r.root, r.name, r.hop) for r in df.collect())
    assert triples(stored_graph.walk(store, roots, depth)) == triples(graph.neighbourhood(graph.edges(now), roots, depth))


def test_edges_are_not_shuffled(spark, stored):
    """On the way from the scan of an edge table to its join there is no exchange."""
    store, now = stored
    plan = stored_graph.walk(store, now.select("name"), 2)._jdf.queryExecution().executedPlan().toString().splitlines()
    scans = [k for k, line in enumerate(plan) if "FileScan parquet" in line and "src" in line and "dst" in line]
    assert len(scans) >= 3
    for k in scans:
        assert "SelectedBucketsCount: 4 out of 4" in plan[k]
        depth = len(plan[k]) - len(plan[k].lstrip(" :+-"))
        above = []
        for line in reversed(plan[:k]):
            d = len(line) - len(line.lstrip(" :+-"))
            if d < depth:
                above.append(line)
                depth = d
                if "Join" in line:
                    break
        assert "Join" in above[-1] and not any("Exchange" in line for line in above)


def test_answers(spark, stored, tmp_path):
    store, now = stored
    edges = graph.edges(now)
    with_edges = sorted({r.src for r in edges.collect()})[0]
    rows = stored_graph.neighbours(store, with_edges.lower(), 1).collect()
    assert [r.name for r in rows if r.part == "root"] == [with_edges]
    assert sorted(r.name for r in rows if r.part == "name_match") == sorted(d for s, d in pairs(edges) if s == with_edges)
    alone = stored_graph.neighbours(store, "I_QqqI").collect()
    assert {r.part for r in alone} == {"root", "area_fallback"} and all(r.area == "A" for r in alone)
    miss = stored_graph.neighbours(store, "rder").collect()
    assert sorted(r.area for r in miss if r.part == "area") == ["A", "B"] and all("rder" in r.name.lower() for r in miss if r.part == "hint")
    (none,) = stored_graph.walk_path(spark, str(tmp_path / "x"), now.select("name"), 1).collect()
    assert none.error and none.root is None and not stored_graph.graph_status(spark, str(tmp_path / "x")).first().built
    assert stored_graph.walk_path(spark, store.path, now.select("name"), 1).where("error IS NOT NULL").count() == 0
    with pytest.raises(layers.Missing):
        layers.open_store(spark, store.path, 9)
