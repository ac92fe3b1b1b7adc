"""The bands of line dedup, and the comparison within buckets that longer bands leave apart."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brindle.llm import candidates, line_dedup


def related(n):
    """2 n lines of 135 long words that all share 117; lines 2 k and 2 k + 1 share four more, which makes them similar."""
    rng = random.Random(33)
    new = lambda k: ["".join(rng.choices("abcdefghijklmnop", k=12)) for _ in range(k)]
    core, lines = new(117), []
    for _ in range(n):
        pair = new(4)
        lines += [" ".join(core + pair + new(14)) for _ in range(2)]
    return lines


def test_related_lines_do_not_join_their_whole_sets(spark, monkeypatch):
    """Related lines that are not similar are told apart within their bucket; rows of all their prefixes are not made."""
    monkeypatch.setattr(candidates, "apart_pairs", lambda *_: pytest.fail("whole sets were joined"))
    lines = related(30)
    got = line_dedup.dropped_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in got) == [(k + 1, k) for k in range(0, 60, 2)]


@pytest.mark.parametrize("medium", [0, 64, 1000])
def test_medium_and_large_buckets_give_the_same(spark, monkeypatch, medium):
    monkeypatch.setattr(candidates, "MEDIUM", medium)
    docs = spark.createDataFrame(list(enumerate(related(40))), "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in line_dedup.dropped_lines(docs).collect()) == [(k + 1, k) for k in range(0, 80, 2)]


@pytest.mark.parametrize("sized", [True, False])
def test_bucket_mates_miss_no_similar_pair(spark, sized):
    rng = random.Random(18)
    sets = []
    for _ in range(5):
        base = [rng.getrandbits(62) - (1 << 61) for _ in range(rng.choice([4, 20, 90, 400]))]
        for _ in range(12):
            kept = [t for t in base if rng.random() > rng.choice([0.02, 0.08, 0.15, 0.4])] + [rng.getrandbits(62) for _ in range(rng.randint(0, len(base) // 6))]
            sets.append({t: 1 if sized or rng.random() < 0.8 else rng.randint(1, 6) for t in kept})
    items = spark.createDataFrame([(f"n{i:03}", t, w) for i, s in enumerate(sets) for t, w in s.items()], "node string, token long, weight long")
    members = [(b, f"n{i:03}", f"p{i // 2:03}") for i, s in enumerate(sets) if s for b in (i % 3, 7) if b < 7 or i % 5]
    found = candidates.bucket_mates(spark.createDataFrame(members, "bucket long, node string, part string"), items, 0.8, sized).collect()
    key = {r.key: int(r.node[1:]) for r in items.select("node").distinct().select("node", F.xxhash64("node").alias("key")).collect()}
    got = [tuple(sorted((key[r.a], key[r.b]))) for r in found]

    def reached(a, b):
        union = a.keys() | b.keys()
        weighted = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in union) for i in a.keys() & b.keys())
        return max(len(a.keys() & b.keys()) / len(union), 0 if sized else weighted) >= 0.8

    of = {i: {b for b, n, _ in members if n == f"n{i:03}"} for i in range(len(sets))}
    pairs = [(i, j) for i, j in combinations(range(len(sets)), 2) if i // 2 != j // 2 and of[i] & of[j]]
    want = {(i, j) for i, j in pairs if reached(sets[i], sets[j])}
    assert want and want <= set(got) <= set(pairs) and len(got) == len(set(got)) < (4 if sized else 8) * len(want)


def test_bands_are_the_first_distinct_hashes_after_each_point(spark):
    rng = random.Random(3)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] * k for n in (1, 2, 3, 5, 40) for k in (1, 3)]
    got = line_dedup.banded(spark.createDataFrame(list(enumerate(lists)), "id int, h array<long>")).orderBy("id").collect()
    assert [r["size"] for r in got] == [len(set(h)) for h in lists]
    points = [(2 * k + 1) * (1 << 64) // 16 - (1 << 63) for k in range(8)]
    rows = []
    for i, h in enumerate(lists):
        ring = sorted(set(h))
        for k, p in enumerate(points):
            start = sum(x < p for x in ring)
            rows.append((i, k, (ring + ring[:3])[start : start + 3]))
    want = spark.createDataFrame(rows, "id int, k int, h array<long>").orderBy("id", "k").select(F.xxhash64("k", "h")).collect()
    assert [b for r in got for b in r.buckets] == [r[0] for r in want]
