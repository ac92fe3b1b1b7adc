"""Periodic runs of words, found on the harmonic grid.

A run of period p and length 2p or more covers two neighbouring points jp and (j + 1)p of the grid
of p. From such a pair the longest common extensions forward and backward give the whole stretch,
so all runs of a text of n words come from n/1 + n/2 + n/3 + ... pairs. An extension is one range
minimum over the LCP array between two suffixes: the forward ones from the suffix array, the
backward ones from that of the reversed words.

A Python worker treats many short texts, or one long text, as one array of numbers in which every
text has its own numbers and ends with a number of its own, so that no extension leaves its text. Memory
is linear in the words of one text (some 4 bytes a word for each doubling of its longest repeat, besides about 100).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, table, texts

MIN_LENGTH = 12
#: Words of short texts that share one array, and grid pairs that are tested at a time.
PACK_WORDS = 1 << 16
PAIRS = 1 << 20
#: Width of the blocks of the range minimum structure.
WIDTH = 16
WORD = r"[^\x20\x09-\x0D]+"


class RangeMin:
    """Minimum of a[l..r] in constant time: prefix and suffix minima of blocks, and a sparse table over whole blocks."""

    def __init__(self, a: np.ndarray) -> None:
        pad = -len(a) % WIDTH
        top = np.iinfo(a.dtype).max
        blocks = np.concatenate((a, np.full(pad, top, a.dtype))).reshape(-1, WIDTH)
        self.a = blocks.ravel()
        self.upto = np.minimum.accumulate(blocks, axis=1).ravel()
        self.since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [blocks.min(axis=1)]
        step = 1
        while 2 * step <= len(blocks):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))
            step *= 2

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        first, last = left // WIDTH, right // WIDTH
        out = np.minimum(self.since[left], self.upto[right])
        near = np.flatnonzero(first == last)
        if len(near):
            low, high = left[near], right[near]
            found = self.a[low]
            for k in range(1, WIDTH):
                found = np.minimum(found, self.a[np.minimum(low + k, high)])
            out[near] = found
        inner = last - first - 1
        size = np.frexp(inner)[1] - 1  # the level whose two windows cover the inner blocks
        for k in range(len(self.levels)):
            at = np.flatnonzero((inner > 0) & (size == k))
            if len(at):
                table_k = self.levels[k]
                out[at] = np.minimum(out[at], np.minimum(table_k[first[at] + 1], table_k[last[at] - (1 << k)]))
        return out


class Extensions:
    """Longest common extension of any two places of an array, from its suffix array, LCP array and range minima.

    Every text within the array must be followed by a number that occurs once.
    """

    def __init__(self, a: np.ndarray) -> None:
        n = len(a)
        order = np.argsort(a, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = True
        fresh[1:] = a[order][1:] != a[order][:-1]
        split = np.where(fresh, -1, 0).astype(np.int8)  # log2 of the equal words known before each suffix of the order, while its group holds
        slot = np.arange(n, dtype=np.int64)
        group = np.maximum.accumulate(np.where(fresh, slot, 0))
        rank = np.empty(n, np.int64)
        rank[order] = group  # a group is named by its first slot, so others keep their names when it is refined
        levels = [rank.astype(np.int32)]
        level = 0
        while True:
            alone = fresh & np.append(fresh[1:], True)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            places = order[slots]
            old = rank[places]
            then = rank[places + (1 << level)]
            by = np.lexsort((then, old))
            places, old, then = places[by], old[by], then[by]
            new = np.empty(len(slots), bool)
            new[0] = True
            new[1:] = (old[1:] != old[:-1]) | (then[1:] != then[:-1])
            order[slots] = places
            fresh[slots] |= new
            level += 1
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
            levels.append(rank.astype(np.int32))
            split[slots[~new]] = level
        lcp = np.where(split < 0, 0, np.left_shift(1, np.maximum(split, 0).astype(np.int32))).astype(np.int32)
        for k in range(int(split.max(initial=-1)) - 1, -1, -1):
            at = np.flatnonzero(split > k)
            left, right = order[at - 1] + lcp[at], order[at] + lcp[at]
            same = levels[k][left] == levels[k][right]
            lcp[at[same]] += 1 << k
        self.rank = rank
        self.least = RangeMin(lcp)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = self.rank[i], self.rank[j]
        return self.least(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def grid(sizes: np.ndarray, starts: np.ndarray, limit: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Period and the two places of every grid pair of texts that start at `starts` and have `sizes` words, some `limit` at a time."""
    half = sizes // 2
    text = np.repeat(np.arange(len(sizes)), half)
    period = np.arange(len(text)) - np.repeat(np.cumsum(half) - half, half) + 1
    count = (sizes[text] - 1) // period
    total = np.cumsum(count)
    at = 0
    while at < len(text):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        c, p = count[at:end], period[at:end]
        pairs = np.repeat(np.arange(len(c)), c)
        j = np.arange(len(pairs)) - np.repeat(np.cumsum(c) - c, c)
        p = p[pairs]
        x = starts[text[at:end]][pairs] + j * p
        yield p, x, x + p
        at = end


def runs(words: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[np.ndarray]:
    """Rows (start, length, period) of every run of each text, by start, then period."""
    sizes = np.array([len(w) for w in words], np.int64)
    n = int(sizes.sum()) + len(words) + 1
    # a text's words stand between numbers of their own
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    a = np.empty(n, np.int64)
    a[0] = 0
    top = 1
    for w, at, size in zip(words, starts.tolist(), sizes.tolist()):
        names: dict[bytes, int] = {}
        a[at : at + size] = [names.setdefault(x, top + len(names)) for x in w]
        top += len(names)
        a[at + size] = top
        top += 1
    found, ahead, behind = [], None, None
    for p, x, y in grid(sizes, starts):
        some = np.flatnonzero(a[x] == a[y])  # a run around the pair holds both places
        if not len(some):
            continue
        p, x, y = p[some], x[some], y[some]
        if ahead is None:
            ahead, behind = Extensions(a), Extensions(a[::-1])
        forward = ahead(x, y)
        backward = behind(n - x, n - y)  # the places before x and y, in the reversed array
        ok = forward + backward >= np.maximum(min_length - p, p)
        found.append(np.stack([x[ok] - backward[ok], y[ok] + forward[ok], p[ok]]))
    if not found:
        return [np.empty((0, 3), np.int64) for _ in words]
    start, end, period = np.concatenate(found, axis=1)
    # of the periods of one stretch, all but the smallest are its multiples
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.ones(len(by), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    by = np.lexsort((period, start))
    rows = np.stack([start, end - start, period], axis=1)[by]
    cut = np.searchsorted(rows[:, 0], starts)
    return [rows[i:j] - [s, 0, 0] for i, j, s in zip(cut, np.append(cut[1:], len(rows)), starts)]


def kept_words(words: list[bytes], rows: np.ndarray) -> list[bytes]:
    """The words that no run repeats: those outside of runs, and the first period of each."""
    if not len(rows):
        return words
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, rows[:, 0] + rows[:, 2], 1)
    np.add.at(step, rows[:, 0] + rows[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step)[:-1] == 0)]


def packs(raw: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """Words of texts, in lists of some PACK_WORDS words; a longer text is alone."""
    pack, size = [], 0
    for t in raw:
        words = (t or b"").split()
        if pack and size + len(words) > PACK_WORDS:
            yield pack
            pack, size = [], 0
        pack.append(words)
        size += len(words)
    if pack:
        yield pack


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per input row: doc_id, runs (array of start, length, period in words, by start, then period), collapsed (the words
    that no run repeats, joined by one space).

    A run is a stretch of at least max(min_length, 2 * period) words, period its smallest period, that no neighbouring word extends.
    Null text counts as empty, and a text without words has no runs and an empty `collapsed`. Runs may overlap; one stretch
    is one run. Rows are treated each for itself, so repeated rows and null ids give rows of their own. No other column is read, and an
    empty table gives no rows.
    """
    rows = texts(docs, id_col, text_col)
    bound_batches(docs.sparkSession, rows=2000, size=4 << 20)
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for pack in packs(batch.column("text").cast(pa.binary()).to_pylist()):
                found = runs(pack, min_length)
                flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
                parts = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(run_type))
                lists = pa.ListArray.from_arrays(pa.array(offsets), parts)
                collapsed = pa.array([b" ".join(kept_words(w, f)) for w, f in zip(pack, found)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(pack)), lists, collapsed], names=["doc_id", "runs", "collapsed"])
                at += len(pack)

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by the CRC-32 of its id) repeats words from some place on, as the query's contract says."""
    rows = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    due = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words").cast("long"))
    due = due.withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    due = due.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", place(i).cast("int")))
    return due.select("doc_id", F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    # the greatest by (length, smallest start, smallest period)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
