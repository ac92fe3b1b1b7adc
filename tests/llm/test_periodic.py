"""Periodic runs against a scan of all periods, and the query's planted rows against a plain version."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from brindle.llm import periodic

DATA = "/root/testdata/sf0.001"


def plain_runs(words, min_length=12):
    """All stretches of every period, kept where no smaller period has the same stretch."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(min_length, 2 * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_kept(words, rows):
    gone = {k for s, n, p in rows for k in range(s + p, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def odd_texts():
    rng = random.Random(11)
    out = [[], [b"a"], [b"a"] * 11, [b"a"] * 12, [b"a"] * 500, [b"a", b"b"] * 6, [b"a", b"b"] * 6 + [b"a"], [bytes([c]) for c in b"abcabcabcabdabcabcabcabc"]]
    for _ in range(150):
        alphabet = [b"x", b"y", b"zz"][: rng.randint(1, 3)]
        out.append(rng.choices(alphabet, k=rng.randint(0, 90)))
    for _ in range(40):
        words = [str(rng.randrange(50)).encode() for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 3)):
            at, p = rng.randrange(len(words)), rng.randint(1, 20)
            words[at:at] = words[at : at + p] * rng.randint(1, 5)
        out.append(words)
    fib = [[b"a"], [b"a", b"b"]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return out + [fib[-1]]


def test_runs_match_a_plain_scan():
    texts = odd_texts()
    got = periodic.runs(texts)
    for words, rows in zip(texts, got, strict=True):
        want = plain_runs(words)
        assert [tuple(r) for r in rows.tolist()] == want
        assert periodic.kept_words(words, rows) == plain_kept(words, want)


def test_small_steps_give_the_same(monkeypatch):
    monkeypatch.setattr(periodic, "grid", lambda sizes, starts, f=periodic.grid: f(sizes, starts, 7))
    texts = odd_texts()[:60]
    assert [r.tolist() for r in periodic.runs(texts)] == [[list(x) for x in plain_runs(w)] for w in texts]
    assert [[list(map(tuple, r)) for r in periodic.runs(texts, m)] for m in (1, 30)] == [[plain_runs(w, m) for w in texts] for m in (1, 30)]


def test_extensions_match_a_scan():
    rng = np.random.default_rng(2)
    a = np.concatenate([rng.integers(0, 2, 300), [7], rng.integers(0, 2, 90), [8]])
    ahead = periodic.Extensions(a)
    i, j = (rng.integers(0, len(a), 4000) for _ in range(2))
    i, j = i[i != j], j[i != j]

    def lce(x, y):
        n = 0
        while max(x, y) + n < len(a) and a[x + n] == a[y + n]:
            n += 1
        return n

    assert ahead(i, j).tolist() == [lce(x, y) for x, y in zip(i, j)]


def test_long_text():
    words = [str(k % 7001).encode() for k in range(60_000)]
    words[30_000] = b"break"
    assert periodic.runs([words])[0].tolist() == [[0, 30_000, 7001], [30_001, 29_999, 7001]]


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rows = plain_runs(words)
    best = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if not rows else 1000 * best[1] // best[2]
    return (doc_id, len(rows), *best, milli, digest("".join(f"{s},{n},{p}\n" for s, n, p in rows)), digest(" ".join(plain_kept(words, rows))))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_matches_brute_force(spark, tmp_path):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs if len(r.text or "") < 4000]
    rows += [(10**6 + k, t) for k, t in enumerate([None, "", " \n", "a b c", "la " * 40, " ".join(rng.choices("ab", k=200))] * 12)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, runs string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in periodic.query(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == sorted(r[0] for r in rows)
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(g[1] > 0 for g in got) > 20


@pytest.mark.parametrize("rows", [[], [(None, "b " * 30, "x"), (1, None, "x"), (1, "b " * 30, "x"), (1, "b " * 30, "x")]])
def test_odd_rows(spark, rows):
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, collapsed string")).collect()
    assert sorted((r.doc_id or 0, len(r.runs), r.collapsed) for r in got) == sorted((i or 0, 1 if t else 0, "b" if t else "") for i, t, _ in rows)
