"""SimHash components against all pairs of fingerprints from an independent definition."""

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from brindle.llm import simhash

SPACE = r"[^\x20\x09-\x0D]+"


def plain_fingerprint(text, hash_of):
    words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [hash_of[s] for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def jvm_hashes(spark, texts):
    """XXH64 of all shingles by Spark's own function, whose seed is 42."""
    every = set()
    for t in texts:
        words = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        every |= {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} | {" ".join(words)}
    rows = spark.createDataFrame([(s,) for s in sorted(every)], "s string").select("s", F.xxhash64("s").alias("h")).collect()
    return {r.s: r.h % (1 << 64) for r in rows}


def classes(keys, near):
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(keys)), 2):
        if near(keys[a], keys[b]):
            parent[find(b)] = find(a)
    return [find(i) for i in range(len(keys))]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "Straße", "日本"]
    base = rng.choices(vocabulary, k=400)
    out = []
    for _ in range(60):  # a large group of near copies
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    out += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(60)]
    out += ["", None, " \t\n", "one", "ONE", "one two", "One\ttwo", "a b c", "a  b\vc", "nbsp stays here too", "x " * 5000, out[0], out[0].upper()]
    return out


def test_components_match_brute_force(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    hash_of = jvm_hashes(spark, texts)
    fps = [plain_fingerprint(t, hash_of) for t in texts]
    label = classes(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == {i: (f"{fp:016x}", min(j for j, x in enumerate(label) if x == label[i])) for i, fp in enumerate(fps)}
    assert len({got[i][0] for i in range(60)}) > 4  # large signatures take the way over points


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_connect_all_within_distance(spark, bits):
    rng = random.Random(bits)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 150:  # balls around a few centres, and strangers
        x = rng.choice([centre, ~centre % (1 << 64), centre ^ 0xFFFFFFFF, rng.getrandbits(64)])
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [] if not bits else simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    got = classes(signed, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := {(r.a, r.b) for r in links}) else list(range(len(fps)))
    assert all(bin((a ^ b) % (1 << 64)).count("1") <= bits for a, b in pairs)
    want = classes(fps, lambda a, b: (a ^ b).bit_count() <= bits)
    assert len(set(got)) == len(set(want)) and len(set(zip(got, want))) == len(set(want))




def test_odd_rows(spark):
    kind = "doc_id long, text string, fingerprint string"
    rows = [(None, "a b c", ""), (5, "a b c", ""), (5, "other words stand here", ""), (5, "a b c", ""), (None, "lonely text of its own", ""), (9, None, ""), (8, "", "")]
    got = sorted((r.doc_id or 0, r.fingerprint[:4], r.component_id or 0) for r in simhash.simhash_components(spark.createDataFrame(rows, kind)).collect())
    assert len(got) == 7 and [g[2] for g in got if g[0] in (8, 9)] == [8, 8]
    assert sum(g[2] == 5 for g in got) == 4 and sum(g[2] == 0 for g in got) == 1
    assert simhash.simhash_components(spark.createDataFrame([], kind)).count() == 0


def test_blocks_give_the_same_fingerprint(texts, monkeypatch):
    whole = [simhash.fingerprint((t or "").encode()) for t in texts]
    blocks = simhash.word_blocks
    for size in (1, 7, 64):
        monkeypatch.setattr(simhash, "word_blocks", lambda raw, size=size: blocks(raw, size))
        assert [simhash.fingerprint((t or "").encode()) for t in texts] == whole
