"""Rate limits, running metrics and stall detection, as streams and as batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, WINDOW_S = 30, 60.0


def accept(window: deque, now: float, limit: int = LIMIT, span: float = WINDOW_S) -> bool:
    """One request: forget what is older than the span, accept while fewer than the limit remain. Rejected ones leave no trace."""
    while window and now - window[0] > span:
        window.popleft()
    if len(window) >= limit:
        return False
    window.append(now)
    return True


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, span: float = WINDOW_S) -> DataFrame:
    """key, order and accepted of each request, in time order within its key.

    Rows are sorted within partitions and streamed: the state of a key is at most `limit` times, however many
    requests it has.
    """
    rows = requests.select(key, F.col(ts).cast("timestamp").cast("double").alias("_at"), order).repartition(key).sortWithinPartitions(key, "_at", order)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = object(), deque()
        for b in batches:
            ok = []
            for k, at in zip(b[key], b["_at"], strict=True):
                if k != now:
                    now, window = k, deque()
                ok.append(accept(window, at, limit, span))
            yield pd.DataFrame({key: b[key], order: b[order], "accepted": ok})

    return rows.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean")


def rate_limited_stream(requests: DataFrame, key: str, ts: str, order: str, limit: int = LIMIT, span: float = WINDOW_S) -> DataFrame:
    """The same on a stream: state per key is the list of accepted times; rows of a micro-batch are taken in time order."""
    rows = requests.select(key, F.col(ts).cast("timestamp").cast("double").alias("at"), order)
    kinds = dict(rows.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window = deque(state.get[0]) if state.exists else deque()
        b = pd.concat(list(batches)).sort_values(["at", order])
        ok = [accept(window, at, limit, span) for at in b["at"]]
        state.update((list(window),))
        yield pd.DataFrame({key: [k[0]] * len(b), order: b[order], "accepted": ok})

    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean"
    return rows.groupBy(key).applyInPandasWithState(run, schema, "times array<double>", "append", "NoTimeout")


def running_metrics(calls: DataFrame, tool: str, ms: str, failed: str) -> DataFrame:
    """tool, count, errors, total_ms so far; for update or complete mode."""
    return calls.groupBy(F.col(tool).alias("tool")).agg(F.count(F.lit(1)).alias("count"), F.count_if(F.expr(failed)).alias("errors"), F.sum(F.col(ms).cast("long")).alias("total_ms"))


def idle_sessions(activity: DataFrame, run: str, ts: str, gap: str = "600 seconds", late: str = "10 minutes") -> DataFrame:
    """run, first and last activity of stretches that ended with `gap` of silence; a stream emits each once it is over."""
    rows = activity.select(run, F.col(ts).cast("timestamp").alias("_ts"))
    if rows.isStreaming:
        rows = rows.withWatermark("_ts", late)
    s = rows.groupBy(run, F.session_window("_ts", gap).alias("w")).agg(F.max("_ts").alias("last_activity"), F.count(F.lit(1)).alias("n"))
    return s.select(run, F.col("w.start").alias("first_activity"), "last_activity", "n")


def append_audit(events: DataFrame, path: str, checkpoint: str):
    """Appends an audit stream as JSON lines; each event once."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def on_change(changes: DataFrame, rebuild, checkpoint: str):
    """Calls rebuild(batch) once for all triggers that came since the last call; never two at a time."""
    return changes.writeStream.foreachBatch(lambda df, _: rebuild(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
