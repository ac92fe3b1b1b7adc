"""Stateful streams against their batch forms, over shuffled micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from brindle.streaming import limits, stateful

pytest.importorskip("google.protobuf")
KIND = "key string, id long, ts double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out, now = [], 1_700_000_000.0
    for i in range(900):
        now += rng.choice([0, 0.1, 0.5, 1, 2, 7])
        out.append((rng.choice(["hot", "hot", "hot", "b", "c"]), i, round(now, 3)))
    out += [("gap", 2000 + k, out[0][2] + t) for k, t in enumerate([0, 60, 60.0, 120.001, 180])]
    return out


def stream_of(spark, rows, folder, batches, rng, shake):
    """Micro-batches that hold rows up to `shake` seconds early or late, and a last one that moves the watermark past all."""
    dealt = sorted(rows, key=lambda r: r[2] + rng.uniform(0, shake))
    step = -(-len(dealt) // batches)
    files = [dealt[i : i + step] for i in range(0, len(dealt), step)] + [[("end", -1, max(r[2] for r in rows) + 10**6)], [("end", -2, max(r[2] for r in rows) + 10**6 + 1)]]
    for k, part in enumerate(files):
        rng.shuffle(part)
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{folder}/{k:03}")
    schema = spark.createDataFrame([], KIND).schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    return raw.withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def drained(df, spark, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.table(name).where("key <> 'end'").collect()


def batch(spark, rows):
    return spark.createDataFrame(rows, KIND).withColumn("ts", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long")))


def test_rate_limit_equals_batch(spark, rows, tmp_path):
    stream = stream_of(spark, rows, tmp_path / "in", 6, random.Random(1), 40)
    got = sorted((r.key, r.id, r.accepted) for r in drained(stateful.rate_limited(stream, "key", "ts", "id", "2 minutes", 10, 20.0), spark, "limited", tmp_path))
    want = sorted((r.key, r.id, r.accepted) for r in limits.rate_limited(batch(spark, rows), "key", "ts", "id", 10, 20.0).collect())
    assert got == want and {a for *_, a in got} == {True, False}


def test_idle_runs_equal_batch(spark, rows, tmp_path):
    sparse = [r for r in rows if r[1] % 17 == 0 or r[0] == "gap"]
    stream = stream_of(spark, sparse, tmp_path / "in", 5, random.Random(2), 50)
    got = sorted((r.key, r.first_activity, r.last_activity, r.n) for r in drained(stateful.idle_runs(stream, "key", "ts", 60.0, "2 minutes"), spark, "idle", tmp_path))
    want = sorted((r.key, r.first_activity, r.last_activity, r.n) for r in limits.idle_sessions(batch(spark, sparse), "key", "ts", "60 seconds").withColumnRenamed("run", "key").collect())
    assert got == want and len(got) > 6


def test_a_burst_is_one_rebuild(spark, tmp_path):
    base = 1_700_000_000.0
    rows = [("index", k, base + t) for k, t in enumerate([0, 1, 4, 8.5, 9, 30, 31])] + [("graph", 50, base + 2)]
    stream = stream_of(spark, rows, tmp_path / "in", 3, random.Random(3), 0)
    calls = []
    requests = stateful.rebuild_requests(stream, "key", "ts", 5.0)
    query = limits.on_change(requests, lambda df: calls.extend((r.key, r.n) for r in df.collect()), str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None and sorted(c for c in calls if c[0] != "end") == [("graph", 1), ("index", 2), ("index", 5)]
