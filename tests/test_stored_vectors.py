"""The stored dense index against all products, its recall, and the choice of the engine."""

import numpy as np
import pytest

from brindle.operators import layers, stored_index, stored_vectors

KIND = "vec_id long, embedding array<float>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], KIND)


@pytest.fixture(scope="module")
def rows():
    """Clusters, one vector for a third of all rows, and unusable rows."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 3
    v = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8)), np.repeat(centres[:1], 450, axis=0)]).astype(np.float32)
    return [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5001, [1.0] * 7 + [None]), (5002, [float("nan")] * 8), (5003, []), (5004, [1.0, 2.0]), (5005, [0.0] * 8)]


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    return stored_vectors.build_vectors(frame(spark, rows), str(tmp_path_factory.mktemp("v") / "s"), cells=16)


def brute(rows, asked, k, least):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v)]
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = set()
    for q, v in good:
        if q in asked:
            scored = sorted((-round(float(unit(v) @ unit(w)), 6), i) for i, w in good)
            out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(scored[:k]) if -s >= least}
    return out


@pytest.mark.parametrize("blocks", [(8192, 2048), (50, 3)])
def test_all_probes_are_exact(spark, rows, store, blocks, monkeypatch):
    monkeypatch.setattr(stored_vectors, "BLOCK", blocks[0])
    monkeypatch.setattr(stored_vectors, "QUERY_BLOCK", blocks[1])
    asked = {*range(0, 1350, 100), 5000, 5002, 5003, 5004, 5005}
    queries = frame(spark, [r for r in rows if r[0] in asked])
    got = {(r.id, r.hit, round(r.score, 6), r.place) for r in stored_vectors.search_vectors(store, queries, 7, None, 0.3).collect()}
    want = {(a, b, round(s, 6), p) for a, b, s, p in brute(rows, asked, 7, 0.3)}
    assert got == want and store.facts["n"] == 1351 and store.facts["dims"] == 8


def test_recall_and_filter(spark, rows, store):
    assert store.facts["probes"] < 16
    r = stored_vectors.recall_of(store, frame(spark, rows[:900:50])).first()
    assert r.queries == 18 and r.recall >= 0.95
    one = stored_vectors.recall_of(store, frame(spark, rows[:900:50]), probes=1).first()
    assert one.found <= r.found
    even = spark.createDataFrame([(i,) for i in range(0, 900, 2)], "id long")
    hits = stored_vectors.search_vectors(store, frame(spark, rows[:1]), 5, None, -2.0, where=even).collect()
    assert len(hits) == 5 and all(h.hit % 2 == 0 for h in hits)


def test_empty(spark, tmp_path):
    none = stored_vectors.build_vectors(frame(spark, [(1, None)]), str(tmp_path / "e"))
    assert none.facts["n"] == 0 and stored_vectors.search_vectors(none, frame(spark, [(1, [1.0])])).count() == 0


def test_the_stored_head_chooses_the_engine(spark, tmp_path):
    def hashed(texts):
        out = np.zeros((len(texts), 16))
        for row, t in zip(out, texts):
            assert t
            for w in t.split():
                row[sum(w.encode()) % 16] += 1
        return out

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["alpha beta", "beta gamma", "", None, "delta " * 3] * 30)], "doc_id long, text string")
    sparse, dense, none = (str(tmp_path / n) for n in ("sparse", "dense", "none"))
    stored_vectors.build_search(docs, sparse)
    stored_vectors.build_search(docs, dense, hashed)
    a = stored_vectors.search_text(spark, sparse, "delta", 3).collect()
    b = stored_vectors.search_text(spark, dense, "delta", 3, hashed).collect()
    assert [r.doc_id for r in a] == [4, 9, 14] == [r.doc_id for r in b] and {r.engine for r in a} == {"tfidf"} and {r.engine for r in b} == {"dense"} and b[0].score == 1.0
    assert stored_vectors.search_text(spark, none, "x").first().error and "encoder" in stored_vectors.search_text(spark, dense, "x").first().error
    assert layers.open_store(spark, dense).facts["n"] == 150 and stored_index.index_status(spark, sparse).first().documents == 150


def test_memory_of_placing_does_not_grow_with_rows_and_cells():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v, centroids = rng.normal(size=(1500, 4)), stored_vectors.unit_rows(rng.normal(size=(32, 4)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500)), pa.array(list(v), pa.list_(pa.float64()))], names=["id", "v"])
    parts = list(stored_vectors.placed(batch, centroids, 32))
    assert max(p.num_rows for p in parts) <= stored_vectors.PLACED < 1500 * 32
    rows = pa.Table.from_batches(parts)
    assert sorted(zip(rows["id"].to_pylist(), rows["cell"].to_pylist())) == [(i, c) for i in range(1500) for c in range(32)]
    assert rows["v"].to_pylist()[-1] == v[1499].tolist()


def test_scores_in_steps_equal_all_at_once(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(300)], "vec_id long, embedding array<double>")
    store = stored_vectors.build_vectors(rows, str(tmp_path / "v"), cells=4)
    found = lambda: sorted(map(tuple, stored_vectors.search_vectors(store, rows, 5, None, -2.0).collect()))
    whole = found()
    monkeypatch.setattr(stored_vectors, "SCORED", 1000)
    assert found() == whole and len(whole) == 1500
