"""The layered index against a full rebuild, after every change."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import layers, search, stored_index
from brindle.plans import catalog

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa the of".split()


def frame(spark, docs):
    return spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string")


def state(store):
    terms = {r.term: (r.df, round(r.idf, 9)) for r in stored_index.term_table(store).collect()}
    hits = [[(r.doc_id, r.score) for r in stored_index.search_store(store, q, 10).collect()] for q in ("kappa", "alpha alpha theta", "the of")]
    return store.facts["n"], terms, hits


def full(spark, docs):
    df = frame(spark, docs)
    terms = {r.term: (r.df, round(r.idf, 9)) for r in search.term_idf(df).collect()}
    index = search.tfidf_index(df, "doc_id")
    hits = [[(r.doc_id, r.score) for r in search.query_index(*index, q, 10).collect()] for q in ("kappa", "alpha alpha theta", "the of")]
    return len(docs), terms, hits


def test_updates_equal_rebuilds(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "the of"]) if rng.random() < 0.1 else " ".join(rng.choices(WORDS, k=rng.randint(1, 12)))
    docs, path = {i: text() for i in range(60)}, str(tmp_path / "index")
    assert state(stored_index.build_index(frame(spark, docs), path)) == full(spark, docs)
    for step in range(2):
        changed = {rng.randrange(80): text() for _ in range(8)} | ({5: "solitary word"} if step == 0 else {5: "alpha"} if step == 1 else {})
        removed = rng.sample(range(90), 5)
        docs = {i: t for i, t in (docs | changed).items() if i not in removed or i in changed}
        store = stored_index.update_index(spark, path, frame(spark, changed), spark.createDataFrame([(i,) for i in removed], "doc_id long"))
        assert state(store) == full(spark, docs)
    assert "solitary" not in state(store)[1]
    before = state(store)
    assert state(stored_index.compact_index(spark, path)) == before
    assert state(layers.open_store(spark, path, 3)) == before  # older versions stay
    docs[7] = "kappa kappa"
    assert state(stored_index.update_index(spark, path, frame(spark, {7: docs[7]}))) == full(spark, docs)
    assert [tuple(r) for r in stored_index.index_status(spark, path).collect()] == [(True, 5, 2, len(docs))]


def test_a_layer_holds_only_what_changed(spark, tmp_path):
    path = str(tmp_path / "index")
    stored_index.build_index(frame(spark, {i: f"common word{i} alpha" for i in range(50)}), path)
    stored_index.update_index(spark, path, frame(spark, {3: "common other alpha"}))
    layer = lambda name: spark.read.parquet(f"{path}/{name}/version=2")
    assert {(r.term, r.df) for r in layer("terms").collect()} == {("word3", -1), ("other", 1)}
    assert layer("postings").count() == 3 and [r.key for r in layer("gone").collect()] == [3]


def test_unfinished_and_missing(spark, tmp_path):
    path = str(tmp_path / "index")
    assert [r.error is not None for r in stored_index.search_path(spark, path, "alpha").collect()] == [True]
    assert not stored_index.index_status(spark, path).first().built
    stored_index.build_index(frame(spark, {1: "alpha", 2: "beta"}), path)
    layers.put(spark.createDataFrame([(1, "zeta", 1, 1)], "doc_id long, term string, tf long, n_terms int"), path, "postings", 2)  # a writer that was lost
    assert [(r.doc_id, r.error) for r in stored_index.search_path(spark, path, "alpha").collect()] == [(1, None)]
    stored_index.update_index(spark, path, frame(spark, {3: "zeta"}))
    assert [r.doc_id for r in stored_index.search_path(spark, path, "zeta").collect()] == [3]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        layers.commit(spark, path, 2, 1, n=9)
    empty = stored_index.build_index(frame(spark, {1: "x"}).where("false"), str(tmp_path / "none"))
    assert stored_index.search_store(empty, "alpha").count() == 0 and empty.facts["n"] == 0


def test_after_a_merge(spark, tmp_path):
    """The delta of a catalog merge gives the index of the merged catalog."""
    path, data = str(tmp_path / "index"), "/root/testdata/sf0.001"
    old, _ = catalog._old_new(spark, data)
    merged = catalog.QUERIES["merge_backfill"](spark, data)
    text = F.concat_ws(" ", F.coalesce("c_name", F.lit("")), F.coalesce("c_mktsegment", F.lit("")))
    stored_index.build_index(old.select(F.col("c_custkey").alias("doc_id"), text.alias("text")), path)
    changed = merged.where("_status <> 'existing'") if "_status" in merged.columns else merged
    store = stored_index.update_index(spark, path, changed.select(F.col("c_custkey").alias("doc_id"), text.alias("text")))
    rebuilt = stored_index.build_index(merged.select(F.col("c_custkey").alias("doc_id"), text.alias("text")), str(tmp_path / "full"))
    assert state(store)[:2] == state(rebuilt)[:2]
    for q in ("building", "customer machinery"):
        assert stored_index.search_store(store, q, 50).collect() == stored_index.search_store(rebuilt, q, 50).collect()


def test_query_terms_reach_the_scan(spark, tmp_path):
    store = stored_index.build_index(frame(spark, {1: "alpha beta", 2: "beta"}), str(tmp_path / "index"))
    plan = stored_index.search_store(store, "beta")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,beta)" in plan or "In(term, [beta" in plan


def test_rare_terms_and_postings_that_are_summed_before_the_gone_go(spark, tmp_path, monkeypatch):
    docs = {i: f"common word{i} word{i // 2} alpha" for i in range(30)}
    path = str(tmp_path / "index")
    for bound in (0, 2):
        monkeypatch.setattr(search, "COMMON", bound)
        stored_index.build_index(frame(spark, docs), path)
        store = stored_index.update_index(spark, path, frame(spark, {3: "common kappa alpha", 99: "alpha theta"}), spark.createDataFrame([(7,)], "doc_id long"))
        assert state(store) == full(spark, {i: t for i, t in docs.items() if i != 7} | {3: "common kappa alpha", 99: "alpha theta"})
    rows = spark.createDataFrame([(3, store.version - 1), (3, store.version), (7, store.version - 1), (8, store.version - 1)], "doc_id long, version int")
    assert sorted(map(tuple, store.still(rows, "doc_id").collect())) == [(3, store.version), (8, store.version - 1)]
