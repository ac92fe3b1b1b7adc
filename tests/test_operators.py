"""Golden rows and small oracles for the operators outside the training-data subpackage."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import catalog, graph, lint, runs, search
from brindle.streaming import limits


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "tokens"),
    [
        ("API_PURCHASEORDER_PROCESS_SRV", ["purchaseorder"]), ("I_PurchaseOrder", ["order", "purchase"]), ("MM_PURCH_DOC_CHECK", ["purch"]),
        ("CE_PURCHASEORDER_0001", ["purchaseorder"]), ("I_JournalEntryItem", ["journal"]), ("SALESORDER2", []), ("PURCHASEREQ01", ["q01"]), ("", []), (None, []), ("I_Item", []),
    ],
)
def test_name_tokens(spark, name, tokens):
    df = spark.createDataFrame([(name,)], "n string")
    got = df.select(T.name_tokens(F.col("n")).alias("t")).first().t
    assert got == tokens


def test_terms(spark):
    df = spark.createDataFrame([("The a_b Café x1 9lives API order ORDER",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(T.terms(F.col("t")).alias("x")).collect()] == [["caf", "x1", "lives", "order", "order"], [], []]


def test_text_helpers(spark):
    df = spark.createDataFrame([(None, " ", "b"), ("", "c", None)], "x string, y string, z string")
    assert [tuple(r) for r in df.select(T.first_filled(F.col("x"), F.col("y"), F.col("z")), T.join_filled(F.col("x"), F.col("y"), F.col("z"))).collect()] == [("b", "  b"), ("c", "c")]
    lists = spark.createDataFrame([(None,), ("",), ("T1",), ('["A","B"]',), ("[bad",)], "x string")
    assert [r.l for r in lists.select(T.text_list(F.col("x")).alias("l")).collect()] == [[], [], ["T1"], ["A", "B"], ["[bad"]]
    assert one(spark, T.strip_tags(F.lit("<p>a <b>b</b>\t c</p>"))) == "a b c"
    assert one(spark, T.occurrences(F.lit("abcabcab"), "abc")) == 2


def test_keyword_modes(spark):
    items = spark.createDataFrame([(1, "Red Bolt", "Area One"), (2, "blue bolt", None), (3, None, "area two")], "id int, name string, area string")
    ids = lambda *a, **k: sorted(r.id for r in search.keyword_search(items, ["name"], *a, **k).collect())
    assert ids("RED bolt") == [1] and ids("red blue", mode="any") == [1, 2] and ids("") == [1, 2, 3] and ids("bolt", area="one") == [1]


def test_tfidf_known_scores(spark):
    docs = spark.createDataFrame([(1, "order item order"), (2, "order"), (3, "zebra"), (4, None)], "id int, text string")
    got = [(r.doc_id, r.score) for r in search.tfidf_search(docs, "order", 5).collect()]
    assert got[0] == (2, 1.0) and got[1][0] == 1 and 0.7 < got[1][1] < 1
    assert search.tfidf_search(docs, "unknownword", 5).count() == 0
    assert search.tfidf_search(docs.where("false"), "order", 5).count() == 0
    postings, _ = search.tfidf_index(docs)
    assert {r.doc_id: round(r.n, 9) for r in postings.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "order item order"), (2, "order"), (3, "zebra"), (4, None)], "id int, text string")
    search.write_index(*search.tfidf_index(docs), f"{tmp_path}/index")
    found = search.query_index(*search.read_index(spark, f"{tmp_path}/index"), "order").collect()
    assert found == search.tfidf_search(docs, "order").collect() and len(found) == 2
    search.write_index(*search.tfidf_index(docs.where("false")), f"{tmp_path}/empty")
    for path in ("empty", "missing"):
        assert search.query_index(*search.read_index(spark, f"{tmp_path}/{path}"), "order").count() == 0


def test_only_possible_hits_are_weighed(spark):
    docs = spark.createDataFrame([(1, "preorder"), (2, "Order!"), (3, "order the"), (4, "x")], "id int, text string")
    assert [r.doc_id for r in search.tfidf_search(docs, "order the").collect()] == [2, 3]


def test_dense_threshold_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], "vec_id int, embedding array<float>")
    assert [r.vec_id for r in search.dense_search(v, [1.0, 0.0], 5).collect()] == [1, 3]


def test_verdict_cascade(spark):
    apis = spark.createDataFrame([("api_known",)], "name string")
    badis = spark.createDataFrame([("Known_Exit",)], "name string")
    views = spark.createDataFrame([("I_Known", ["mara", None, ""]), ("I_Other", ["MARA"]), ("I_None", None)], "name string, replaces array<string>")
    names = [("bapi_foo", None), (" mara ", None), ("API_KNOWN", None), ("KNOWN_EXIT", None), ("i_known", None), ("P_FOO", "cds"), ("I_FOO", None), ("CE_FOO", None), ("FOO_SRV", None), ("ABC_FOO_CHECK", None), ("zz1_thing", None), ("x", "odata"), ("x", "bapi"), ("x", "badi"), (None, None)]
    got = [(r.object_name, r.rule, r.verdict, r.verified) for r in catalog.release_verdicts(spark.createDataFrame(names, "name string, type string"), apis, badis, views).collect()]
    rules = {n: r for n, r, _, _ in got if n != "X"}
    assert rules == {"BAPI_FOO": 1, "MARA": 2, "API_KNOWN": 3, "KNOWN_EXIT": 4, "I_KNOWN": 5, "P_FOO": 6, "I_FOO": 7, "CE_FOO": 8, "FOO_SRV": 8, "ABC_FOO_CHECK": 9, "ZZ1_THING": 10, "": 10}
    assert sorted(r for n, r, _, _ in got if n == "X") == [1, 8, 9]
    assert {v for _, r, v, ok in got if ok} == {"NOT_AVAILABLE"} and len(got) == len(names)


def test_merge_and_idempotence(spark):
    old = spark.createDataFrame([("a", None, "x"), ("b", "", "y"), ("c", "t", None)], "name string, title string, area string")
    new = spark.createDataFrame([("a", "A", "q"), ("b", "B", "q"), ("d", "D", "q"), ("d", "D", "q"), (None, "N", "q")], "name string, title string, area string")
    real = {r.name: tuple(r) for r in catalog.merge_backfill(old, new, "name", ["title"]).collect()}
    assert real == {"a": ("a", "A", "x", "backfilled"), "b": ("b", "", "y", "existing"), "c": ("c", "t", None, "existing"), "d": ("d", "D", "q", "added")}
    dry = {r.name: r._status for r in catalog.merge_backfill(old, new, "name", ["title"], empty_too=True).collect()}
    assert dry["b"] == "backfilled"
    merged = catalog.merge_backfill(old, new, "name", ["title"]).drop("_status")
    assert {r._status for r in catalog.merge_backfill(merged, new, "name", ["title"]).collect()} == {"existing"}
    first = catalog.insert_or_ignore(old, new.withColumn("n", F.monotonically_increasing_id()).select("name", "title", "area"), "name", ["title"])
    assert sorted(r.name for r in first.collect()) == ["a", "b", "c", "d"]
    assert sorted((r.name, r.title) for r in catalog.upsert(old, new.where("name = 'a'"), "name").collect()) == [("a", "A"), ("b", ""), ("c", "t")]


def test_lessons(spark):
    rows = spark.createDataFrame([("t", "l", "report", "", ["x"], "RUN-ID71"), ("", "l", None, "", [], ""), ("t", "about id71 here", None, "", [], "RUN-ID71"), ("t", "l", "odd", "", [], ""), ("t", "l" * 1300, None, "", [], "")], "topic string, lesson string, category string, impact string, tags array<string>, source string")
    assert [r.error for r in catalog.lesson_errors(rows, ["general", "report"]).collect()] == [None, "topic and lesson are needed", "names the customer", "unknown category", "too long"]
    assert one(spark, catalog.anonymous_source(F.lit("Pipeline run"))) == "Pipeline run" and len(one(spark, catalog.anonymous_source(F.lit("client")))) == 8


def test_lint_lines(spark):
    rules = [lint.Rule("E", "error", r"CALL\s+X"), lint.Rule("W", "warning", "foo(?!bar)"), lint.Rule("B", "error", "(")]
    df = spark.createDataFrame([(1, "CALL X\r\n  foo\nfoobar"), (2, "CALL\nX"), (3, ""), (4, None), (5, "foo\n")], "doc_id int, text string")
    assert sorted((r.doc_id, r.rule, r.line, r.code) for r in lint.lint(df, rules).collect()) == [(1, "E", 1, "CALL X"), (1, "W", 2, "foo"), (5, "W", 1, "foo")]
    assert [(r.error_count, r.warning_count, r.verdict) for r in lint.verdicts(df, rules).orderBy("doc_id").collect()] == [(1, 1, "FAIL"), (0, 0, "PASS"), (0, 0, "PASS"), (0, 0, "PASS"), (0, 1, "WARN")]


def test_graph_edges_match_nested_loop(spark):
    rng = random.Random(2)
    stems = ["pur", "purchase", "purchaseorder", "sal", "sales", "salesorder", "cost", "costcenter", "led", "ledger"]
    rows = [(f"{k}_{i}", kind, [rng.choice(stems) for _ in range(rng.randint(0, 3))]) for k, kind in enumerate(("api", "view", "badi")) for i in range(15)]
    nodes = spark.createDataFrame(rows, "name string, type string, tokens array<string>")
    pair = lambda x, y: (lambda short, long: len(short) >= 3 and len(long) >= 6 and long.startswith(short))(*sorted((x, y), key=len))
    related = lambda a, b: any(pair(x, y) for x in a for y in b)
    want = {(a, b) for a, ta, xa in rows for b, tb, xb in rows if ta != tb and related(xa, xb)}
    got = {(r.src, r.dst) for r in graph.edges(nodes).collect()}
    assert got == want and all((b, a) in got for a, b in got)
    dist = {}
    for root, *_ in rows[:5]:
        seen, queue = {root: 0}, deque([root])
        while queue:
            u = queue.popleft()
            for a, b in want:
                if a == u and b not in seen and seen[u] < 2:
                    seen[b] = seen[u] + 1
                    queue.append(b)
        dist |= {(root, n): d for n, d in seen.items() if d}
    roots = spark.createDataFrame([(r[0],) for r in rows[:5]], "name string")
    assert {(r.root, r.name): r.hop for r in graph.neighbourhood(graph.edges(nodes), roots, 2).collect()} == dist


def test_graph_precedence_resolution_fallback(spark):
    api = spark.createDataFrame([("X_Same", "Sales", "api one"), ("API_LONELY_SRV", "Sales", "t"), ("", "q", "q")], "name string, area string, title string")
    badi = spark.createDataFrame([("X_Same", "Buying", "", "use")], "name string, area string, title string, use_case string")
    n = graph.nodes(api=api, badi=badi)
    assert {(r.name, r.type, r.title) for r in n.collect()} == {("X_Same", "badi", "use"), ("API_LONELY_SRV", "api", "t")}
    for text, name in (("x_same", "X_Same"), ("api_lon", "API_LONELY_SRV")):
        assert graph.resolve(n, text).first().name == name
    assert graph.resolve(n, "none").count() == 0
    more = n.unionByName(spark.createDataFrame([("ZZ", "view", "Sales", "", [])], n.schema))
    out = graph.object_graph(more, graph.edges(more), more.where("name = 'ZZ'").select("name"))
    assert [(r["mode"], r.name) for r in out.collect()] == [("area_fallback", "API_LONELY_SRV")]


def test_runs(spark):
    rows = spark.createDataFrame([("A", "f"), ("A-R2", "f"), ("A-R10", "f"), ("B", "g")], "id string, source string")
    assert {r.id: (r.version, r.previous_run, r.run_count) for r in runs.run_history(rows, "id", "source").collect()} == {"A": (1, None, 3), "A-R2": (2, "A", 3), "A-R10": (10, "A-R2", 3), "B": (1, None, 1)}
    assert {r.source: r.next_run for r in runs.next_run(rows, "id", "source").collect()} == {"f": "A-R11", "g": "B-R2"}
    f = spark.createDataFrame([("r", s, d) for s in ("Critical", "Major", "Minor", "Other") for d in (True, False)] + [("bad", "Major", False)] * 14, "run string, s string, d boolean")
    assert {r.run: (r.score, r.blockers) for r in runs.quality_scores(f, "run", F.col("s"), F.col("d")).collect()} == {"r": (81, 1), "bad": (0, 0)}


def test_redaction(spark):
    js = '{"a": {"Token": "x\\"y", "b": [1]}, "token": {"z": 1}, "password":12.5, "tokens": "stay"}'
    assert one(spark, runs.redact(F.lit(js), ["token", "password"])) == '{"a": {"Token": "***REDACTED***", "b": [1]}, "token": "***REDACTED***", "password":"***REDACTED***", "tokens": "stay"}'


def test_redaction_of_nested_values(spark):
    js = '{"token": {"a": {"b": [1, {"c": "}{]["}]}}, "x": 1}'
    assert one(spark, runs.redact(F.lit(js), ["token"])) == '{"token": "***REDACTED***", "x": 1}'
    deep = '{"token": ' + "[" * 40 + '"secret"' + "]" * 40 + ', "x": 1}'
    assert "secret" not in one(spark, runs.redact(F.lit(deep), ["token"]))


def test_repeated_batch_keys(spark):
    old = spark.createDataFrame([("a", None, 0)], "k string, v string, n int")
    new = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "p", 1), ("b", "q", 2)], "k string, v string, n int")
    assert sorted(map(tuple, catalog.upsert(old, new, "k", ["n"]).collect())) == [("a", "y", 2), ("b", "q", 2)]
    merged = catalog.merge_backfill(old, new, "k", ["v"], order=["n"]).collect()
    assert sorted((r.k, r.v, r.n, r._status) for r in merged) == [("a", "x", 0, "backfilled"), ("b", "p", 1, "added")]


def test_last_comment_wins(spark):
    f = spark.createDataFrame([("F1", "a.md"), ("F2", "b.md")], "id string, file string")
    c = spark.createDataFrame([("F1", "one", 1), ("a.md", "two", 2), ("zz", "no", 3)], "target string, text string, n int")
    assert {r.id: r.comment for r in runs.apply_comments(f, c).collect()} == {"F1": "two", "F2": None}


def brute_limit(rows, limit, span):
    out, windows = {}, {}
    for key, at, n in sorted(rows, key=lambda r: (r[1], r[2])):
        w = [x for x in windows.get(key, []) if at - x <= span]
        out[n] = len(w) < limit
        windows[key] = w + [at] * out[n]
    return out


def test_rate_limit_batch_and_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), float(rng.randrange(300)), n) for n in range(120)] + [("c", 0.0, 500), ("c", 60.0, 501), ("c", 60.5, 502)]
    df = spark.createDataFrame(rows, "k string, s double, n int").selectExpr("k", "timestamp_micros(cast(s * 1000000 as bigint)) AS ts", "n")
    want = brute_limit(rows, 2, 60)
    assert {r.n: r.accepted for r in limits.rate_limited(df, "k", "ts", "n", 2, 60.0).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.rate_limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "ts", "n", 2, 60.0)
    q = stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.n: r.accepted for r in spark.table("limited").collect()} == want


def test_idle_sessions_and_metrics(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, 1.9), ("r", 500, 2.0), ("r", 2000, 3.0)], "run string, s int, ms double").selectExpr("run", "timestamp_seconds(s) AS ts", "ms")
    assert sorted(r.n for r in limits.idle_sessions(df, "run", "ts").collect()) == [1, 2]
    df.write.parquet(str(tmp_path / "in"))
    m = limits.running_metrics(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "run", "ms", "ms > 2.5")
    q = m.writeStream.format("memory").queryName("metrics").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("metrics").collect()] == [("r", 3, 1, 6)]


def test_terms_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "beta alpha the beta X1 9zz"), (2, None), (3, ""), (4, "the of"), (5, "Beta b beta")], "id long, text string")
    counts = search.term_counts(docs)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id, r.term, r.tf, r.n_terms) for r in counts.collect())
    assert got == [(1, "alpha", 1, 5), (1, "beta", 2, 5), (1, "x1", 1, 5), (1, "zz", 1, 5), (5, "beta", 2, 2)]


def test_rare_terms_get_the_same_idf_as_frequent_ones(spark, monkeypatch):
    rows = spark.createDataFrame([(d, f"w{t}", d % 3 + 1) for t in range(20) for d in range(t + 1)], "doc_id long, term string, tf long")
    idf = spark.createDataFrame([(f"w{t}", t + 1, 1.0 / (t + 1)) for t in range(20)], "term string, df long, idf double")
    found = lambda: sorted(map(tuple, search.with_idf(rows, idf).select("doc_id", "term", "tf", "idf").collect()))
    whole = found()
    assert whole == sorted(map(tuple, rows.join(idf, "term").select("doc_id", "term", "tf", "idf").collect()))
    for bound in (0, 3, 7, 100):
        monkeypatch.setattr(search, "COMMON", bound)
        assert found() == whole


def test_search_weighs_like_an_index(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 11 + 10}" for k in range(1, i % 7 + 3)) + (" alpha" if i % 3 == 0 else " alphabet")) for i in range(40)], "id long, text string")
    for bound in (0, 3, 1000):
        monkeypatch.setattr(search, "COMMON", bound)
        for query in ("alpha w13", "alpha alpha nothing", "nothing", "the"):
            assert search.tfidf_search(docs, query, 50, least=0.0).collect() == search.query_index(*search.tfidf_index(docs), query, 50, 0.0).collect()
