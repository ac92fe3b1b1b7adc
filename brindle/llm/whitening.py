"""Whitening of embeddings by TSQR: the right singular vectors of the centred rows, without their covariance.

1. Entries become fixed-point numbers, and a vector a short byte string, so that equal vectors meet in
   map-side aggregates and cross the network at a byte or two per entry. Each distinct vector counts once.
2. Column sums are exact integers. Rows are centred as n * x - sum, exactly, and only then divided by n.
3. Every partition reduces its rows to a triangular factor R, a batch at a time. Groups of `FAN_IN` factors are
   stacked and factored again, level by level, until one is left; its singular values and right vectors are
   those of all rows. A factor has as many rows and columns as a vector has entries, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, checkpointed, table

SCALE = 256
COMPONENTS = 4
#: Factors that one task stacks.
FAN_IN = 16
#: Singular values below this share of the largest are zero to double precision.
TINY = 1e-13
LIMB = 24
LONG = np.iinfo(np.int64)


def fixed_point(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * value) as int64; what a long can't hold becomes its nearest bound."""
    x = np.floor(values.astype(np.float64) * scale)
    out = np.empty(x.shape, np.int64)
    low, high = x <= float(LONG.min), x >= float(LONG.max)
    np.copyto(out, np.where(low | high, 0, x).astype(np.int64))
    out[low], out[high] = LONG.min, LONG.max
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """Each row as little-endian integers of the fewest bytes (1, 2, 4 or 8) that hold it, so equal rows have equal bytes, after that width."""
    out: list[bytes] = [b""] * len(x)
    left = np.arange(len(x))
    for width in (1, 2, 4, 8):
        kind = np.dtype(f"<i{width}")
        fits = ((x[left] >= np.iinfo(kind).min) & (x[left] <= np.iinfo(kind).max)).all(axis=1)
        for i, row in zip(left[fits].tolist(), x[left[fits]].astype(kind)):
            out[i] = bytes([width]) + row.tobytes()
        left = left[~fits]
    return out


def unpacked(column: pa.Array) -> np.ndarray:
    """The rows of a batch as one int64 matrix."""
    return np.array([np.frombuffer(b, f"<i{b[0]}", offset=1) for b in column.to_pylist()], np.int64)


def pack_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x (packed) and dims of each row whose vector is neither null nor empty and has finite entries only."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = v.flatten()
            offsets = np.asarray(v.offsets) - v.offsets[0].as_py()
            bad = np.asarray(flat.is_null()) | ~np.isfinite(flat.fill_null(0).to_numpy(zero_copy_only=False))
            sums = np.concatenate(([0], np.cumsum(bad)))
            good = np.flatnonzero(sums[offsets[1:]] == sums[offsets[:-1]])
            values = fixed_point(flat.fill_null(0).to_numpy(zero_copy_only=False)[np.repeat(sums[offsets[1:]] == sums[offsets[:-1]], np.diff(offsets))], scale)
            sizes = np.diff(offsets)[good]
            ends = np.cumsum(sizes)
            if len(good) and (sizes == sizes[0]).all():
                x = packed(values.reshape(len(good), -1))
            else:
                x = [packed(values[e - s : e][None])[0] for s, e in zip(sizes.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(good)), pa.array(x, pa.binary()), pa.array(sizes.astype(np.int32))], names=["id", "x", "dims"])

    return rows.mapInArrow(run, f"id {kind}, x binary, dims int")


def column_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("x"))
                rows += len(x)
                # two halves, so that no sum of a batch leaves 64 bits
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + w for t, h, w in zip(total, high, low)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([rows] * dims, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], names=["d", "n", "s"])

    parts = fit.select("x").mapInArrow(run, "d int, n bigint, s decimal(38,0)")
    found = {r.d: (r.n, int(r.s)) for r in parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s")).collect()}
    return (found[0][0], [found[d][1] for d in range(dims)]) if found else (0, [])


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: int64 if it fits, else Python integers."""
    largest = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * largest + max(map(abs, total)) < 1 << 62:
        return n * x - np.array(total, np.int64)
    return n * x.astype(object) - np.array(total, object)


def squared_norms(dev: np.ndarray) -> list[int]:
    """Exact sum of squares of each row."""
    if dev.dtype == object or np.abs(dev).max(initial=0) >= 1 << 2 * LIMB:
        return [sum(v * v for v in row) for row in dev.tolist()]
    high, low = dev >> LIMB, dev & ((1 << LIMB) - 1)
    parts = [(p * q).sum(axis=1).tolist() for p, q in ((high, high), (high, low), (low, low))]
    return [(hh << 2 * LIMB) + (hl << LIMB + 1) + ll for hh, hl, ll in zip(*parts)]


def triangular(rows: np.ndarray) -> np.ndarray:
    """R of a QR factorisation, square: with zero rows where there are fewer rows than columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def reduced(df: DataFrame, column: str, dims: int, to_rows: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """One factor R for each partition that has rows, folded in a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if batch.num_rows:
                rows = to_rows(batch.column(column))
                r = triangular(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r, "<f8").tobytes()], pa.binary())], names=["r"])

    return df.select(column).mapInArrow(run, "r binary")


def tsqr(fit: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The factor R of all centred rows; every level of the tree is a Spark stage over factors only."""
    dims = len(total)
    stack = lambda column: np.concatenate([np.frombuffer(b, "<f8").reshape(dims, dims) for b in column.to_pylist()])
    now = checkpointed(reduced(fit, "x", dims, lambda column: deviations(unpacked(column), n, total).astype(np.float64) / n))
    count = now.count()
    while count > 1:
        tasks = -(-count // FAN_IN)
        now = checkpointed(reduced(now.repartition(tasks), "r", dims, stack))
        count = now.count()
    return np.frombuffer(now.first().r, "<f8").reshape(dims, dims)


@dataclass
class Whitening:
    """A fitted transform. `vectors` has a column per component, `scales` its standard deviation (0: none to double precision)."""

    n: int
    total: list[int]
    vectors: np.ndarray
    scales: np.ndarray
    explained: np.ndarray

    def apply(self, dev: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows n * x - total; NaN along components without variance."""
        safe = np.where(self.scales > 0, self.scales, np.nan)
        return dev.astype(np.float64) / self.n @ self.vectors / safe


def fit_whitening(fit: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening | None:
    """Fitted to the distinct packed vectors `fit` (column x); None without rows."""
    n, total = column_sums(fit, dims)
    if not n:
        return None
    _, s, right = np.linalg.svd(tsqr(fit, n, total))
    s = np.where(s > TINY * s[0], s, 0.0)
    e = s * s / n
    kept = min(components, dims)
    return Whitening(n, total, right[:kept].T.copy(), np.sqrt(e[:kept]), e[:kept] / e.sum() if s[0] > 0 else np.zeros(kept))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened fit rows - identity), over components with variance."""
    use = np.flatnonzero(model.scales > 0)
    k = len(use)
    if not k:
        return 0.0

    def sums(of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    part = of(model.apply(deviations(unpacked(batch.column("x")), model.n, model.total))[:, use])
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "s"])

        found = {r.i: r.s for r in fit.select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()}
        return np.array([found[i] for i in range(len(found))])

    mean = sums(lambda y: y.sum(axis=0)) / model.n
    cov = sums(lambda y: (y - mean).T @ (y - mean)).reshape(k, k) / model.n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """One row per vector that remains: id, n (distinct vectors in the fit), deviation (exact squared length of n * x - sums), whitened (an
    entry per component, the strongest first), explained (share of the variance, per component), identity_error.

    Null and empty vectors and those with null or non-finite entries go. Where the rest have different lengths, the most frequent length
    stays (of equally frequent ones the longest). Entries beyond a 64-bit number of fixed point count as its bounds. Repeated
    vectors and ids keep their rows, but a vector counts once in the fit. A component without variance (to double precision) has
    whitened null and explained 0; with fewer entries than components there are as many components as entries.
    A deviation of more than 38 digits is null. Components of equal variance are any basis of their space. Without rows
    the result is empty. Columns other than the two named are not read.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = pack_vectors(df, id_col, vector_col, scale)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows = checkpointed(rows)
    first = rows.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if first is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.col("dims") == first.dims)
    fit = checkpointed(rows.select("x").distinct())
    model = fit_whitening(fit, first.dims, components)
    error = identity_error(fit, model)
    explained = model.explained.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dev = deviations(unpacked(batch.column("x")), model.n, model.total)
            y = [[None if np.isnan(v) else v for v in row] for row in model.apply(dev).tolist()]
            size = [Decimal(v) if v < 10**38 else None for v in squared_norms(dev)]
            same = lambda v, kind: pa.array([v] * batch.num_rows, kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), same(model.n, pa.int64()), pa.array(size, pa.decimal128(38, 0)), pa.array(y, pa.list_(pa.float64())), same(explained, pa.list_(pa.float64())), same(error, pa.float64())],
                names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select("id", "x").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "part")
    return found.select("id", "n", "deviation", "identity_error", each).select(
        F.col("id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        F.col("deviation").try_cast("long").alias("deviation"),
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
    )
