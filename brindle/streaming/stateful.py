"""Stateful streams that agree with their batch forms, however rows are dealt over micro-batches.

Rows wait in state until the watermark has passed them and are then taken in time order. A key's
rows are read one after the other; no micro-batch of a key is gathered in memory.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brindle.streaming.limits import LIMIT, WINDOW_S, accept

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are held before they go to the state store.
HELD = 1000


def _stateful(df: DataFrame) -> DataFrame:
    """State variables and timers need the RocksDB state store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


class RateLimiter(StatefulProcessor):
    """Accepts or rejects each request of a key, second by second as the watermark passes.

    State per key: the requests of seconds that are not over, and the at most `limit` times that still count.
    """

    def __init__(self, key: str, order: str, order_type: str, limit: int, span: float):
        self.key, self.order, self.order_type, self.limit, self.span = key, order, order_type, limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "second bigint", f"requests array<struct<at: double, id: {self.order_type}>>")
        self.counted = handle.getListState("counted", "at double")

    def _store(self, held: dict[int, list[tuple]]) -> None:
        for second, requests in held.items():
            before = self.waiting.getValue((second,))
            if before is None:
                self.handle.registerTimer((second + 1) * 1000)
            self.waiting.updateValue((second,), ([*map(tuple, before[0] if before else []), *requests],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held: dict[int, list[tuple]] = {}
        for n, row in enumerate(rows, 1):
            held.setdefault(math.floor(row["_at"]), []).append((row["_at"], row[self.order]))
            if n % HELD == 0:
                self._store(held)
                held = {}
        self._store(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = expiredTimerInfo.getExpiryTimeInMs() // 1000
        due = self.waiting.getValue((end - 1,))
        times = deque(t[0] for t in self.counted.get()) if self.counted.exists() else deque()
        for at, id_ in sorted(map(tuple, due[0])) if due else []:
            yield Row(**{self.key: key[0], self.order: id_, "accepted": accept(times, at, self.limit, self.span)})
        if due:
            self.waiting.removeKey((end - 1,))
            self.handle.registerTimer((end + math.ceil(self.span) + 1) * 1000)  # then nothing of this second counts any more
        while times and end - times[0] > self.span:
            times.popleft()
        if times:
            self.counted.put([(t,) for t in times])
        else:
            self.counted.clear()


def rate_limited(requests: DataFrame, key: str, ts: str, order: str, late: str = "1 minute", limit: int = LIMIT, span: float = WINDOW_S) -> DataFrame:
    """key, order and accepted of each request of a stream, once the watermark (`late` behind the newest) has passed its second.

    Equal to limits.rate_limited over the same rows, in whatever order they come within `late`. Rows without key or time go.
    """
    rows = requests.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, order, F.col(ts).cast("timestamp").alias("_ts"))
    rows = _stateful(rows.withWatermark("_ts", late)).withColumn("_at", F.col("_ts").cast("double"))
    kinds = dict(rows.dtypes)
    processor = RateLimiter(key, order, kinds[order], limit, span)
    return rows.groupBy(key).transformWithState(processor, f"{key} {kinds[key]}, {order} {kinds[order]}, accepted boolean", "Append", "EventTime")


class Quiet(StatefulProcessor):
    """Stretches of a key's rows without a pause longer than `gap`, each emitted by a timer when the pause is over.

    State per key: first and last time and number of rows of the stretches that are still open.
    """

    def __init__(self, key: str, gap: float):
        self.key, self.gap = key, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "stretches array<struct<first: double, last: double, n: bigint>>")

    def _joined(self, stretches: list[tuple], at: float) -> list[tuple]:
        near = [s for s in stretches if s[0] - self.gap <= at <= s[1] + self.gap]
        first, last, n = min([at, *(s[0] for s in near)]), max([at, *(s[1] for s in near)]), 1 + sum(s[2] for s in near)
        return [s for s in stretches if s not in near] + [(first, last, n)]

    def _load(self) -> list[tuple]:
        return [tuple(s) for s in self.open.get()[0]] if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = stretches = self._load()
        for row in rows:
            stretches = self._joined(stretches, row["_at"])
        for s in set(stretches) - set(before):
            self.handle.registerTimer(math.ceil((s[1] + self.gap) * 1000))
        self.open.update((stretches,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        stretches = self._load()
        over = sorted(s for s in stretches if math.ceil((s[1] + self.gap) * 1000) <= now)
        for first, last, n in over:
            yield Row(**{self.key: key[0], "_first": first, "_last": last, "n": n})
        left = [s for s in stretches if s not in over]
        if left:
            self.open.update((left,))
        else:
            self.open.clear()


def quiet_stretches(activity: DataFrame, key: str, ts: str, gap: float, late: str) -> DataFrame:
    rows = activity.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, F.col(ts).cast("timestamp").alias("_ts"))
    rows = _stateful(rows.withWatermark("_ts", late)).withColumn("_at", F.col("_ts").cast("double"))
    found = rows.groupBy(key).transformWithState(Quiet(key, gap), f"{key} {dict(rows.dtypes)[key]}, _first double, _last double, n bigint", "Append", "EventTime")
    return found.select(key, F.timestamp_micros(F.round(F.col("_first") * 1_000_000).cast("long")).alias("first"), F.timestamp_micros(F.round(F.col("_last") * 1_000_000).cast("long")).alias("last"), "n")


def idle_runs(activity: DataFrame, run: str, ts: str, gap: float = 600.0, late: str = "10 minutes") -> DataFrame:
    """run, first_activity, last_activity and n of a stream's stretches that ended with `gap` seconds of silence; a timer closes each.

    Equal to limits.idle_sessions over the same rows. Rows without run or time go.
    """
    return quiet_stretches(activity, run, ts, gap, late).select(run, F.col("first").alias("first_activity"), F.col("last").alias("last_activity"), "n")


def rebuild_requests(changes: DataFrame, target: str, ts: str, quiet: float = 5.0, late: str = "0 seconds") -> DataFrame:
    """One row per burst of changes to a target (no pause over `quiet` seconds): target, first and last change, n. A rebuild that
    takes these rows (limits.on_change) runs once per burst, whatever micro-batches the burst came in."""
    return quiet_stretches(changes, target, ts, quiet, late).select(target, F.col("first").alias("first_change"), F.col("last").alias("last_change"), "n")
