"""The length-weighted score against a sum over all labellings of a text's lines."""

import math
import random
from itertools import product

import numpy as np

from brindle.llm import quality


def plain_score(model, text):
    """Marginals by enumeration, from the line features alone; no vector code is shared."""
    lines = (text or b"").split(b"\n")
    x = [[(v - m) / s for v, m, s in zip(quality.line_features(line), model.mean, model.scale)] for line in lines]
    none = [0.0] * len(quality.NAMES)
    emit = []
    for k in range(len(lines)):
        near = [*(x[k - 1] if k else none), *x[k], *(x[k + 1] if k + 1 < len(lines) else none), 1.0]
        emit.append(sum(a * b for a, b in zip(near, model.weights)))
    total, good = 0.0, [0.0] * len(lines)
    for labels in product((0, 1), repeat=len(lines)):
        weight = math.exp(sum(e for e, y in zip(emit, labels) if y) + sum(model.stay[2 * a + b] for a, b in zip(labels, labels[1:])))
        total += weight
        for k, y in enumerate(labels):
            good[k] += weight * y
    size = [max(len(line), 1) for line in lines]
    return sum(n * g / total for n, g in zip(size, good)) / sum(size)


def test_scores_match_enumeration(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["alpha", "Beta.", "12%", "###", "gamma", "x"]) for _ in range(rng.randint(0, 9)))
    texts = ["\n".join(line() for _ in range(rng.randint(1, 9))) for _ in range(60)] + [None, "", "\n", "é\n\nÜ 1"]
    k = len(quality.NAMES)
    draw = np.random.default_rng(3)
    model = quality.Model(draw.normal(size=k), draw.uniform(0.5, 2, k), draw.normal(size=3 * k + 1), draw.normal(size=4) * 2)
    want = [plain_score(model, None if t is None else t.encode()) for t in texts]
    assert np.allclose(quality.score_batch(model, [None if t is None else t.encode() for t in texts]), want, atol=1e-9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r._score for r in quality.score(docs, model).collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in enumerate(want)) and len(got) == len(texts)
