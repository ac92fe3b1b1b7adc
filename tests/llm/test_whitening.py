"""Whitening against an eigendecomposition of the exact covariance."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import whitening

KIND = "vec_id long, embedding array<float>, n int"


def vectors(rows, dims, seed):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims)) * np.geomspace(2, 0.2, dims)
    return (rng.normal(size=(rows, dims)) @ mix + rng.normal(size=dims)).astype(np.float32)


def plain(rows):
    """Fixed point, distinct fit rows, their exact sums, and numpy's eigenvectors."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v, _ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, e[::-1], v[:, ::-1]


def test_matches_eigenvectors(spark, tmp_path):
    x = vectors(700, 12, 4)
    rows = [(i, [float(c) for c in v], 3) for i, v in enumerate(x)]
    rows += [(i, rows[0][1], 3) for i in range(2000, 2300)]  # a third of all rows is one vector
    rows += [(3000, None, 3), (3001, [1.0] * 11 + [None], 3), (3002, [1.0] * 11 + [float("nan")], 3), (3003, [float("inf")] * 12, 3), (None, rows[5][1], 3), (7, rows[9][1], 3), (3004, [-0.0] * 12, 3), (3005, [0.0] * 12, 3), (3006, [], 3)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, KIND).repartition(40).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = whitening.query(spark, str(tmp_path)).collect()
    rows = [r for r in rows if r[1] != []]
    kept, n, sums, e, v = plain(rows)
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n}
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got if r.component == 1) == sorted((-1 if i is None else i, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for i, x in kept)
    want = {}
    for i, x in kept:
        y = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ v[:, :4] / np.sqrt(e[:4])
        want.setdefault(i, []).append(y)
    for k in range(1, 5):
        mine = {r.vec_id: r.whitened for r in got if r.component == k}
        one = next(i for i in mine if i is not None and abs(want[i][0][k - 1]) > 0.3)
        sign = math.copysign(1, mine[one] * want[one][0][k - 1])
        assert all(min(abs(y - sign * w[k - 1]) for w in want[i]) < 1e-8 for i, y in mine.items())
        assert all(abs(r.explained - e[k - 1] / e.sum()) < 1e-9 for r in got if r.component == k)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_tree_of_factors(spark):
    """More partitions than one task stacks: every level of the tree gives the same R up to signs."""
    x = np.floor(256 * vectors(400, 5, 1).astype(np.float64)).astype(np.int64)
    fit = spark.createDataFrame([(b,) for b in whitening.packed(x)], "x binary").repartition(60).distinct().repartition(60)
    n, total = whitening.column_sums(fit, 5)
    assert n == 400 and total == x.sum(axis=0).tolist()
    r = whitening.tsqr(fit, n, total)
    centred = x - x.sum(axis=0) / n
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10)


def test_nearly_equal_columns_keep_their_precision(spark):
    """A variance 1e-12 of the largest, which a covariance in doubles would blur."""
    rng = np.random.default_rng(0)
    x = rng.integers(-(10**9), 10**9, size=(300, 3))
    x[:, 2] = x[:, 1] + rng.integers(-100, 100, size=300)
    fit = spark.createDataFrame([(b,) for b in whitening.packed(x)], "x binary")
    model = whitening.fit_whitening(fit, 3)
    s = np.linalg.svd(x - x.mean(axis=0), compute_uv=False)
    assert np.allclose(model.scales, s / np.sqrt(300), rtol=1e-7)
    assert whitening.identity_error(fit, model) < 1e-4


@pytest.mark.parametrize("width", [3, 1 << 10, 1 << 40, 1 << 62])
def test_exact_norms(width):
    rng = random.Random(width)
    x = np.array([[rng.randint(-width, width) for _ in range(9)] for _ in range(30)] + [[-width] * 9], np.int64)
    assert whitening.unpacked(whitening.pa.array(whitening.packed(x), whitening.pa.binary())).tolist() == x.tolist()
    total = [sum(c) for c in zip(*x.tolist())]
    dev = whitening.deviations(x, 31, total)
    assert whitening.squared_norms(dev) == [sum((31 * a - t) ** 2 for a, t in zip(row, total)) for row in x.tolist()]


def test_fixed_point():
    values = np.array([0.0, -0.0, 1 / 256, -1 / 257, 1e300, -1e300, 2.0**55 - 8, 0.999])
    assert whitening.fixed_point(values, 256).tolist() == [0, 0, 1, -1, 2**63 - 1, -(2**63), 2**63 - 2048, 255]


def test_odd_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, KIND)
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None, 0), (2, [], 0), (3, [float("nan")], 0)])).count() == 0
    one = whitening.whiten(make([(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [None, None], [0.0, 0.0], 0.0)] * 2
    mixed = whitening.whiten(make([(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [0.0, 5.0], 0), (4, [2.0], 0), (5, [3.0, 1.0], 0)])).collect()
    assert sorted(r.id for r in mixed) == [2, 3, 5] and all(len(r.whitened) == 2 for r in mixed)
    tie = whitening.whiten(make([(1, [1.0], 0), (2, [1.0, 2.0], 0), (3, [0.0, 5.0], 0), (4, [2.0], 0)])).collect()
    assert sorted(r.id for r in tie) == [2, 3] and all(r.whitened[1] is None for r in tie)
    large = whitening.whiten(make([(1, [3e38, 0.0], 0), (2, [-3e38, 1.0], 0), (3, [0.0, 3.0], 0)])).collect()
    assert sorted(r.id for r in large) == [1, 2, 3] and all(r.deviation is None or r.deviation >= 0 for r in large)
