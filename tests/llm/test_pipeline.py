"""The pipeline against a brute-force version of its stages, and its registration."""

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from brindle.llm import decontaminate, near_dedup, packing, quality

def classes(keys, alike):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(keys, 2):
        if alike(a, b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in keys}


def brute_lines(docs):
    places = defaultdict(list)
    for i in sorted(docs):
        for k, raw in enumerate(docs[i].split("\n")):
            norm = " ".join(raw.split()).lower()
            if norm:
                places[norm].append((i, k))
    sets = {n: {n[i : i + 10] for i in range(max(1, len(n) - 9))} for n in places}
    label = classes(sorted(places), lambda a, b: sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = defaultdict(list)
    for n, c in label.items():
        groups[c] += places[n]
    gone = {p for g in groups.values() for p in g if p != min(g)}
    out = {}
    for i, t in docs.items():
        kept = [raw for k, raw in enumerate(t.split("\n")) if (i, k) not in gone]
        if len(kept) == len(t.split("\n")) or any(x.strip() for x in kept):
            out[i] = "\n".join(kept)
    return out


def brute_near(docs):
    hashes = near_dedup.WordHashes()
    sets = {i: near_dedup.shingles([near_dedup.words(t.encode())], hashes)[1:] for i, t in docs.items()}
    label = classes(sorted(docs), lambda a, b: max(near_dedup.jaccard(sets[a], sets[b])) >= 0.8 or (not len(sets[a][0]) and docs[a] == docs[b]))
    return {i: t for i, t in docs.items() if label[i] == i}


def brute_benchmark(docs, items):
    out = {}
    for i, t in docs.items():
        places = list(re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", t))
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), m[0]) for m in places]
        hit = set()
        for iw in items:
            n = min(10, len(iw))
            for k in range(len(iw) - n + 1 if n else 0):
                hit |= {j for s in range(len(ws) - n + 1) if ws[s : s + n] == iw[k : k + n] for j in range(s, s + n)}
        if len(hit) <= decontaminate.MAX_COVERAGE * len(ws):
            text, at = "", 0
            for j, m in enumerate(places):
                if j in hit:
                    text += t[at : m.start()] if j - 1 not in hit else ""
                    at = m.end()
            out[i] = text + t[at:]
    return out


@pytest.fixture(scope="module")
def data(tmp_path_factory, spark):
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(2, 8))) for _ in range(500)]
    line = lambda n: " ".join(rng.choices(vocabulary, k=n)) + "."
    texts = ["\n".join(line(rng.randint(3, 40)) for _ in range(rng.randint(1, 5))) for _ in range(50)]
    items = [line(14)[:-1] for _ in range(5)] + ["two words"]
    texts += [f"{line(30)} {items[0]}. {line(30)}", items[1], f"{line(20)}\n{items[2]} {line(3)}", f"x {line(30)} two, Words"]
    texts += [texts[0], "\n".join([*texts[1].split("\n"), line(12)]), " ".join(texts[2].split()[:-1]), texts[5].replace("\n", " "), ""]
    texts += [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=40)) for _ in range(15)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, int("!!" not in t), 0) for i, t in enumerate(texts) if t], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, dict(enumerate(texts)), [re.findall(r"\w+", t) for t in items]


def test_pipeline_matches_brute_force(spark, data):
    folder, texts, items = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    scores = {r.doc_id: r._score for r in quality.score(docs, quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))).collect()}
    want = {i: t for i, t in texts.items() if scores[i] >= quality.THRESHOLD}
    assert all("!!" not in t for t in want.values()) and len(want) > 50
    steps = [want]
    for brute in (brute_lines, brute_near, lambda d: brute_benchmark(d, items)):
        steps.append(brute(steps[-1]))
    assert len({len(s) for s in steps}) == 4  # each stage drops something
    for (_, stage), after in zip(corpus_pipeline.STAGES, steps):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {r.doc_id: r.text for r in rows} == after and all(r.n_chars == len(r.text) for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    e, pieces = packing.Encoder(packing.tokenizer_path()), defaultdict(int)
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces[r.doc_id] += r.length
    assert pieces == {i: len(e.whole(t)) + 1 for i, t in steps[-1].items()}


def test_pipeline_on_empty_table(spark, data, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{data[0]}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_every_operator_is_registered_once():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13


def test_stages_on_odd_rows(spark, data):
    """Nulls, blanks, repeated rows and ids, a long text and clashing names: no stage crashes, and clean documents stay."""
    folder, texts, _ = data
    clean = next(t for i, t in texts.items() if i < 50 and len(t.split()) > 60)
    rng = random.Random(2)
    long = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(1500))
    extra = ["row", "class", "_spans", "_items", "part", "key", "node", "n", "score", "line"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    rows = [(1, clean), (1, clean), (2, None), (3, ""), (3, ""), (None, "some lonely words of its own"), (None, None), (4, " \n\t\n"), (5, long), (5, "another text under the same id, with words of its own")]
    docs = spark.createDataFrame([(i, t, None, "s", None, *extra) for i, t in rows], kind)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).collect()
        if name == "packing":
            assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}
            continue
        assert out and list(out[0].asDict()) == docs.columns and all(tuple(r)[5:] == tuple(extra) for r in out)
        assert any(r.doc_id == 1 and r.text == clean for r in out)
        if name != "quality classifier":
            assert any(r.doc_id == 5 and r.text == long for r in out) and any(r.doc_id is None for r in out)
