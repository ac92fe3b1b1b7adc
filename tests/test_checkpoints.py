"""Entries at checkpoints, dashboards in their order, and odd rows."""

from pyspark.sql import functions as F

from brindle.operators import checkpoints as c


def test_the_dashboard_is_ordered(spark):
    job = "array<struct<job:string,kind:string,input:bigint,output:bigint,cost_usd:double>>"
    usage = spark.createDataFrame([("a", "fd a", "2024-01-02", 5, 1, 0.5, [("j", "A", 1, None, None)]), ("b", "fd b", "2024-01-03", 1, 1, 0.1, None), ("z", None, None, None, None, None, [])], f"run string, fd string, last_updated string, input long, output long, est_cost double, jobs {job}")
    runs = spark.createDataFrame([("a", "Title", "done", "2024-01-01"), ("c", "C", None, "2024-01-01"), ("d", None, "new", "2024-01-09"), ("b", "", None, None)], "run string, title string, status string, created string")
    rows = c.usage_dashboard(usage, runs).collect()
    assert [(r.run, r.title, r.status, r.total_input) for r in rows] == [("b", "fd b", "unknown", 1), ("a", "Title", "done", 5), ("z", "", "unknown", 0), ("d", "", "new", 0), ("c", "C", "", 0)]
    assert [tuple(p) for p in rows[1].phases] == [("j", "A", 1, 0, 0.0)] and rows[3].phases == []


def test_names(spark):
    kind = "run string, id string, object string, type string, created_in string, name string"
    names = spark.createDataFrame([("r", "1", "o", "t", "tenant", "bad"), ("r", "2", "o", "t", "btp", "good"), ("s", "1", "", "", "", "ZOLD"), ("t", "1", "", "", "", "ZT")], kind)
    edits = spark.createDataFrame([("r", "1", " ZA1 ", 1), ("r", "1", None, 0), ("r", "9", "ZX", 1), ("s", "x", " ZNEW ", 5)], "run string, id string, name string, n int")
    swaps = spark.createDataFrame([("s", [("x", "obj", None, "tenant", "first")], 1), ("t", [], 1), ("u", None, 1)], f"run string, contract {c.ENTRY}, n int")
    got = c.edited_names(names, edits, swaps)
    assert sorted((r.run, r.id, r.name, r.type) for r in got.collect()) == [("r", "1", "ZA1", "t"), ("r", "2", "good", "t"), ("s", "x", "ZNEW", "")]
    assert sorted(map(tuple, c.name_counts(got).collect())) == [("r", 2, 2), ("s", 1, 1)]


def test_comments_ticks_and_decisions(spark):
    files = spark.createDataFrame([("r", "a", "old", 1), ("r", "b", None, 2), ("r", "c", "keep", 3)], "run string, id string, comment string, size int")
    said = spark.createDataFrame([("r", "a", " ", 2), ("r", "a", "early", 1), ("r", "b", "x" * 5000, 1), ("r", "none", "y", 1)], "run string, id string, text string, n int")
    done = c.commented_files(files, said)
    assert sorted((r.id, len(r.comment), r.size) for r in done.collect()) == [("a", 1, 1), ("b", 4000, 2), ("c", 4, 3)]
    assert [tuple(r) for r in c.comment_counts(done).collect()] == [("r", 2, 3)]
    lists = spark.createDataFrame([("r", ["a", "b", "c"]), ("s", ["a"]), ("t", []), ("u", None)], "run string, checklist array<string>")
    ticks = spark.createDataFrame([("r", [True, None], 2), ("r", [False], 1), ("t", [True], 1)], "run string, checked array<boolean>, n int")
    assert sorted((r.run, r.state, r.checked, r.total) for r in c.checklist_state(lists, ticks).collect()) == [("r", [True, False, False], 1, 3), ("s", [False], 0, 1)]
    review = spark.createDataFrame([("r", "1", None, None), ("r", "2", "fix", "n"), ("r", "3", None, "n")], "run string, id string, action string, notes string")
    acts = spark.createDataFrame([("r", "1", "accept", "z" * 3000, 1), ("r", "2", "maybe", "", 1), ("r", None, "fix", "", 1), ("r", "", "fix", "", 1)], "run string, id string, action string, notes string, n int")
    now = c.decided(review, acts)
    assert sorted((r.id, r.action, len(r.notes)) for r in now.collect()) == [("1", "accept", 2000), ("2", "fix", 1), ("3", None, 1)]
    findings = spark.createDataFrame([("r", "1", " critical", None), ("r", "2", "MAJOR", "Resolved"), ("r", "3", "minor", "Accepted"), ("r", "4", None, None), ("q", "1", "Major", None)], "run string, id string, severity string, status string")
    assert sorted(map(tuple, c.review_result(findings, now).collect())) == [("q", 92, 0, 0), ("r", 100 - 5 - 8 - 1, 2, 3)]


def test_files(spark):
    rows = [("a", "07-x-Review.md"), ("a", "07-review.md"), ("b", "7_b_review.md"), ("b", "07-a-reviews.md"), ("c", "08-review.md"), ("d", "07-review.txt")]
    assert sorted(map(tuple, c.review_file(spark.createDataFrame(rows, "folder string, file string")).collect())) == [("a", "07-review.md"), ("b", "07-a-reviews.md")]
    built = spark.createDataFrame([("a", "1.mtar", "2024-01-01 11:59:59"), ("a", "0.mtar", "2020-01-01 00:00:00"), ("b", "1.mtar", "2024-01-01 10:00:00"), ("c", "1.zip", "2024-01-01 11:00:00")], "folder string, file string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    assert [r.folder for r in c.fresh_artifact(built, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()] == ["a"]
