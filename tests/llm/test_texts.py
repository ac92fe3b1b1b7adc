"""Secrets, personal data, exact copies, decontamination, quality: odd inputs and brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import decontaminate, exact_dedup, pii, quality, secrets

#: Extra columns whose names the operators use themselves.
CLASH = "doc_id long, text string, findings string, recipe int, norm int, keep_id string, kept int, has_digit int, email string"


def table(spark, texts, first=0):
    rows = [(i + first, t, "x", 1, 2, "y", 3, 4, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH)


# ------------------------------------------------------------------ secrets

BASE = {
    "assign": (re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 8),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
}


@pytest.fixture(scope="module")
def secret_texts():
    rng = random.Random(3)
    parts = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "ABCDEFGH12345678", "0123456789abcdef" * 2, "ghp_" + "a1" * 20, "xoxb-1234567890-ab", "é", "\n", "AIza" + "x" * 36, "-----BEGIN RSA PRIVATE KEY-----", "longvalue.x/y+z="]
    return ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(150)] + ["", None, "Kelvin Key apiKey:12345678", "tokenſ: 12345678"]


def test_secrets_match_plain_scan(spark, secret_texts):
    got = {r.doc_id: [(f.kind, f.start, f.end) for f in r.findings] for r in secrets.find_secrets(table(spark, secret_texts)).collect()}
    for i, t in enumerate(secret_texts):
        want = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE.values()) for m in p.finditer(t or "") if ok(m)]
        assert [g for g in got[i] if g[0] in BASE] == [(list(BASE)[k], s, e) for s, k, e in sorted(want)]
    assert {g[0] for f in got.values() for g in f} >= {"github", "slack", "google", "pem", *BASE}


def test_trigram_queries_are_necessary():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("abcd") == ("and", ["abc", "bcd"])
    assert secrets.trigram_query("(abc|xyz)d?") == ("or", [("and", ["abc"]), ("and", ["abc", "bcd"]), ("and", ["xyz"]), ("and", ["xyz", "yzd"])])
    assert secrets.trigram_query("(abc)*x") is None
    rng = random.Random(1)
    for r in secrets.compiled(secrets.RULES):
        hits = ["".join(rng.choices("aAkiIpwstoenKcr_:='Xx09f", k=12)) for _ in range(50)] + ["password=abcdefgh", "AKIA" + "A" * 16, "f" * 40]
        index = secrets.block_index(hits, sorted(secrets.trigrams_of(r[2])))
        rows = set(secrets.candidates(r[2], index, len(hits)).tolist())
        assert {i for i, t in enumerate(hits) if r[1].search(t)} <= rows


def test_secrets_empty_and_repeated(spark):
    df = table(spark, ["token=abcdefgh1"]).union(table(spark, ["token=abcdefgh1"]))
    assert [len(r.findings) for r in secrets.find_secrets(df).collect()] == [1, 1]
    assert secrets.find_secrets(df.where("false")).count() == 0


# ------------------------------------------------------------------ personal data

PLAIN = {k: re.compile(p) for k, p in pii.PLAIN.items()}


def luhn(s):
    d = [int(c) for c in reversed(re.sub("[^0-9]", "", s))]
    return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10 == 0


CHECKS = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": luhn, "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}


def test_pii_matches_plain_patterns(spark):
    rng = random.Random(7)
    parts = ["a@b.c", "x.y+z@mail.example.org", "@", ".", "-", " ", "_d", "1.2.3.4", "256.1.1.1", "007.08.9.0255", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-456", "+1", "(", ")", "12", "é", "\n", "5", "GB82WEST12345698765432", "0000000000000000000", "mail "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(250)] + ["", None, "9" * 5000, "a" * 5000, "1-" * 4000, "a." * 3000 + "@b" + ".c" * 3000, "a@b.c_d@e.f"]
    got = {r.doc_id: r for r in pii.find_pii(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for kind, ok in CHECKS.items():
            assert [(s.start, s.end) for s in got[i][kind]] == [m.span() for m in PLAIN[kind].finditer(t or "") if ok(m[0])], (kind, t)
    assert sum(len(r.iban) for r in got.values()) > 0


def test_many_spans_are_placed(spark):
    text = "é 1.2.3.4 " * 2000
    r = pii.find_pii(table(spark, [text])).first()
    assert [(s.start, s.end) for s in r.ip] == [m.span() for m in PLAIN["ip"].finditer(text)]


def test_context_raises_the_score_and_masking(spark):
    r = {r.doc_id: r.findings for r in pii.find_pii(table(spark, ["call me: +49 30 123456", "x +49 30 123456"])).collect()}
    assert r[0][0].score == pytest.approx(0.9) and r[1][0].score == pytest.approx(0.6)
    assert [m.text for m in pii.mask_pii(table(spark, ["to a@b.c, 10.0.0.1!", None])).collect()] == ["to [EMAIL], [IP]!", ""]
    assert pii.find_pii(table(spark, []).where("false")).count() == 0


# ------------------------------------------------------------------ exact copies


def check_copies(rows, texts):
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for t in texts]
    for r in rows:
        same = [i for i, n in enumerate(norm) if n == norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(11)
    long = " ".join(rng.choices(["and", "other", "words.", "straße", "x"], k=6000))
    return [long, long + "!", long.replace(" ", "\t \n"), "!" + long, "a b", "a\nb", "a  b ", "", None, " ", "\x0b\x0c", "x" * 30000, "x" * 30001, "x" * 30000, "a\xa0b"]


def test_exact_copies(spark, copies):
    check_copies(exact_dedup.exact_dedup(table(spark, copies)).collect(), copies)


def test_exact_copies_with_clashing_names(spark, copies):
    """A name that stands for many chunks must not join different texts."""
    bad = lambda c: F.length(c).cast("long") % 2
    check_copies(exact_dedup.exact_dedup(table(spark, copies), name=bad).collect(), copies)


def test_exact_copies_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b"), (5, "c")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert got == sorted([(-1, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (-1, None, 1, True), (5, 5, 1, True)], key=str)
    assert exact_dedup.exact_dedup(df.where("false")).count() == 0


# ------------------------------------------------------------------ decontamination


def brute(ws, items, window):
    hit, found = set(), set()
    for item, iw in items:
        size = min(window, len(iw))
        if size:
            wins = {tuple(iw[k : k + size]) for k in range(len(iw) - size + 1)}
            for i in range(len(ws) - size + 1):
                if tuple(ws[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found.add(item)
    return hit, found


@pytest.mark.parametrize("window", [2, 4, 10])
def test_automaton_matches_brute_force(window):
    rng = random.Random(window)
    for _ in range(60):
        items = [(str(k), [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 14))]) for k in range(5)]
        auto = decontaminate.Automaton(items, window)
        for _ in range(5):
            ws = [rng.choice([b"a", b"b", b"c", b"zz"]) if rng.random() < 0.3 else rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
            spans, found = auto.scan(ws)
            hit, want = brute(ws, items, window)
            assert ({i for a, b in spans for i in range(a, b)}, found) == (hit, want)
            assert all(a < b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


ITEM = "one two three four five six seven eight nine ten eleven"


def test_decontaminate(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "Short Item"), (3, None), (4, ""), (5, "...")], "item_id long, text string")
    texts = [f"Before it. {ITEM.upper()}! after, " + "more words here " * 8, "a short,item b c d e f g h i", None, "", ITEM, "nothing to see", "one two three four five six seven eight nine"]
    docs = table(spark, texts)
    for block in (10**6, 3):
        got = {r.doc_id: (r._n_words, [tuple(s) for s in r._spans], r._items) for r in decontaminate.find_leaks(docs, bench, block_words=block).collect()}
        assert got[0][1:] == ([(2, 13)], ["1"]) and got[1] == (11, [(1, 3)], ["2"]) and got[2] == got[3] == (0, [], []) and got[4][1] == [(0, 11)]
        assert got[5][1] == got[6][1] == []
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    kept = {r.doc_id: r.text for r in clean.collect()}
    assert set(kept) == {0, 1, 2, 3, 5, 6} and kept[0].startswith("Before it. ! after, more") and kept[1] == "a  b c d e f g h i" and kept[2] is None
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).where("size(_spans) > 0").count() == 0


# ------------------------------------------------------------------ quality


def brute_marginals(emit, stay):
    n, t = len(emit), stay.reshape(2, 2)
    total, good = 0.0, np.zeros(n)
    for k in range(2**n):
        y = [k >> i & 1 for i in range(n)]
        p = np.exp(sum(e * v for e, v in zip(emit, y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    return good / total, np.log(total)


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    counts = np.array([3, 1, 6, 1, 4])
    emit, stay = rng.normal(size=15), rng.normal(size=4)
    good, pairs, z = quality.forward_backward(emit, counts, stay)
    at = 0
    for n, logz in zip(counts, z):
        want, total = brute_marginals(emit[at : at + n], stay)
        assert good[at : at + n] == pytest.approx(want) and logz == pytest.approx(total)
        at += n
    assert pairs.sum() == pytest.approx((counts - 1).sum())


def test_quality_learns_and_scores(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(12)) for _ in range(4))
    texts = [good() if i % 3 else bad() for i in range(240)] + [None, "", "\n\n", "x" * 200000, "a\n" * 20000]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(7, 1, 0), (None, 1, 0), (9, None, 0), (10**6, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r._score for r in quality.score(docs, model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all((got[i] >= quality.THRESHOLD) == (i % 3 > 0) for i in held)
    assert len(got) == len(texts) and all(0 <= s <= 1 for s in got.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    untrained = quality.train(docs, labels.where("false"))
    assert all(r._score == pytest.approx(0.5) for r in quality.score(docs, untrained).collect())
    assert quality.score(docs.where("false"), model).count() == 0


def test_top_word_counts_every_word_of_a_line():
    top = quality.NAMES.index("top_word")
    assert quality.line_features(b"a b c d " + b"spam " * 36)[top] == 36 / 40
    assert quality.line_features(b"a b c b")[top] == 2 / 4


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    docs = table(spark, ["\n".join(["plain words here."] * 60 + ["12345"] * 60)] * 40)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    digit = quality.NAMES.index("digit")
    assert quality.train(docs, labels).mean[digit] == pytest.approx(0.5)
    monkeypatch.setattr(quality, "MAX_TRAIN_DOCS", 5)  # 300 lines: two whole documents
    assert quality.train(docs, labels).mean[digit] == pytest.approx(0.5)


def test_long_texts_stay_linear(spark):
    began = time.time()
    text = "password" * 20000 + " " + "AKIA" * 20000 + "f" * 100000
    secrets.scan_block([text], secrets.compiled(secrets.RULES))
    assert time.time() - began < 10


def test_decontaminate_keeps_columns_of_any_name(spark):
    item = "one two three four five six seven eight nine ten eleven"
    columns = ["text", "doc_id", "_items", "_n_words", "_spans", "row", "n_words", "spans", "items", "start", "a.b"]
    rows = [(f"lead words before it stand here {item} and many more words after it than there are inside of it", 1, *"cdefghijk"), (None, None, *"cdefghijk"), ("", 1, *"cdefghijk"), ("", 1, *"cdefghijk"), ("word " * 50_000 + item, 2, *"cdefghijk")]
    docs = spark.createDataFrame(rows, columns)
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "")], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench)
    got = out.collect()
    assert out.columns == columns and len(got) == 5 and all(tuple(r)[2:] == tuple("cdefghijk") for r in got)
    assert [r.text for r in got][1:4] == [None, "", ""] and not any(item in (r.text or "") for r in got)
    assert [r.text for r in decontaminate.decontaminate(docs, bench.where("item_id > 1")).collect()] == [r[0] for r in rows]
    leaks = decontaminate.find_leaks(docs, bench)
    assert sorted(leaks.columns) == sorted(columns) and [r["_n_words"] for r in leaks.collect()][1:4] == [0, 0, 0]
