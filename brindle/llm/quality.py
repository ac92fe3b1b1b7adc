"""Document quality from a linear-chain conditional random field over lines.

Each line is labelled good or bad from its own features and those of its neighbours; transitions tie
successive labels together. The field is fitted on a bounded sample of labelled documents, read whole (each
line takes its document's label). Scoring runs forward-backward over every line of every text, vectorised
over the documents of an Arrow batch, and a document's score is the length-weighted mean of its lines'
marginals. No shuffle: a document is scored where it is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, table

#: The fit's bounds: labelled documents (those with the smallest hashes of their ids) and their lines on average.
#: Documents are read whole; one whose lines would exceed the sum is left out of the sample.
MAX_TRAIN_DOCS, MAX_TRAIN_LINES = 4000, 60
STEPS, RATE, RIDGE = 80, 0.1, 1e-3
THRESHOLD = 0.3
FOLDS = 5

UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
SYMBOLS = b"!\"#$%&()*+/<=>?@[\\]^_`{|}~"
NAMES = ("empty", "length", "words", "word_length", "upper", "digit", "symbol", "symbol_words", "distinct_words", "top_word", "no_stop", "starts_lower")


def line_features(line: bytes) -> tuple[float, ...]:
    n = len(line)
    words = line.split()
    if not words:
        return (1.0, *[0.0] * (len(NAMES) - 1))
    w = len(words)
    times = Counter(words)
    seen = len(times)
    upper, lower = n - len(line.translate(None, UPPER)), n - len(line.translate(None, LOWER))
    last = line.rstrip()[-1:]
    return (
        0.0,
        min(np.log1p(n) / 10, 1.5),
        min(np.log1p(w) / 8, 1.5),
        min((n - w + 1) / w / 20, 2.0),
        upper / (upper + lower + 1),
        (n - len(line.translate(None, DIGITS))) / n,
        (n - len(line.translate(None, SYMBOLS))) / n,
        sum(map(ends_odd, words)) / w,
        seen / w,
        max(times.values()) / w,
        float(last not in b".!?"),
        float(line[:1] in LOWER),
    )


def ends_odd(word: bytes) -> bool:
    return word[-1] in SYMBOLS


def lines_of(text: bytes | None) -> list[bytes]:
    """Lines of a text; an empty or null text is one empty line."""
    return (text or b"").split(b"\n")


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features of the previous, own and next line, then a constant: good minus bad
    stay: np.ndarray  # scores of (bad, bad), (bad, good), (good, bad), (good, good)


def batch_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, weights (bytes, at least 1) and the number of lines of each text."""
    rows, weights, counts = [], [], []
    for text in texts:
        lines = lines_of(text)
        counts.append(len(lines))
        for line in lines:
            rows.append(line_features(line))
            weights.append(max(len(line), 1))
    return np.array(rows, dtype=np.float64).reshape(-1, len(NAMES)), np.array(weights, dtype=np.float64), np.array(counts, dtype=np.int64)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Adds the features of the line before and after (zero at the ends) and a constant."""
    starts = np.cumsum(counts) - counts
    before, after = np.vstack([x[:1] * 0, x[:-1]]), np.vstack([x[1:], x[:1] * 0])
    before[starts], after[starts + counts - 1] = 0, 0
    return np.hstack([before, x, after, np.ones((len(x), 1))])


def forward_backward(emit: np.ndarray, counts: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal probability of good for each line, expected transitions (2x2), and log partition per text.

    Texts go from long to short, so that step t works on the first texts only, as one vector operation.
    """
    order = np.argsort(-counts, kind="stable")
    n, starts = counts[order], (np.cumsum(counts) - counts)[order]
    longest = int(n[0])
    active = np.searchsorted(-n, -np.arange(longest), side="left")  # texts with more than t lines
    t2 = stay.reshape(2, 2)
    alpha, beta = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    e = np.column_stack([np.zeros(len(emit)), emit])
    alpha[starts] = e[starts]
    for t in range(1, longest):
        at = starts[: active[t]] + t
        a = alpha[at - 1][:, :, None] + t2
        alpha[at] = np.logaddexp(a[:, 0], a[:, 1]) + e[at]
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = t2 + (e[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(b[:, :, 0], b[:, :, 1])
    last = starts + n - 1
    z = np.empty(len(counts))
    z[order] = np.logaddexp(alpha[last, 0], alpha[last, 1])
    zl = np.repeat(z, counts)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - zl, 0))
    inner = np.ones(len(emit), dtype=bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + t2 + (e[at] + beta[at])[:, None, :] - zl[at][:, None, None])
    return good, pair.sum(axis=0), z


def fit(x: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> Model:
    """Maximum likelihood with a ridge, by Adam over the whole sample; deterministic."""
    if not len(counts):
        k = len(NAMES)
        return Model(np.zeros(k), np.ones(k), np.zeros(3 * k + 1), np.zeros(4))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    full = with_neighbours((x - mean) / scale, counts)
    y = np.repeat(quality, counts).astype(float)
    per_doc = np.repeat(1.0 / counts, counts)
    seen = np.array([(counts - 1)[quality == 0].sum(), 0, 0, (counts - 1)[quality == 1].sum()], dtype=float)
    theta = np.zeros(full.shape[1] + 4)
    m, v, lines = np.zeros_like(theta), np.zeros_like(theta), float(counts.sum())
    for step in range(1, STEPS + 1):
        good, pairs, _ = forward_backward(full @ theta[:-4], counts, theta[-4:])
        grad = np.concatenate([full.T @ (y - good), seen - pairs.ravel()]) / lines - RIDGE * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, theta[:-4], theta[-4:])


def score_batch(model: Model, texts: list[bytes | None]) -> np.ndarray:
    x, weights, counts = batch_features(texts)
    good, _, _ = forward_backward(with_neighbours((x - model.mean) / model.scale, counts) @ model.weights, counts, model.stay)
    starts = np.cumsum(counts) - counts
    return np.clip(np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts), 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Fits on at most `max_docs` labelled documents outside the held-out fold. Conflicting labels of one id count as 0."""
    spark = docs.sparkSession
    bound_batches(spark)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_quality")).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
    lines = F.greatest(F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n", -1)), F.lit(1)), F.lit(1))
    sizes = docs.select(F.col(id_col).alias("_id"), lines.alias("_lines")).join(F.broadcast(chosen), "_id").groupBy("_id", "_quality").agg(F.sum("_lines").alias("_lines"))
    picked, left = [], MAX_TRAIN_DOCS * MAX_TRAIN_LINES
    for r in sizes.orderBy(F.xxhash64("_id"), "_id").collect():  # at most max_docs rows
        if r._lines <= left:
            picked.append((r._id, r._quality))
            left -= r._lines
    chosen = spark.createDataFrame(picked, sizes.drop("_lines").schema)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _, counts = batch_features(batch.column("_text").to_pylist())
                ends = np.cumsum(counts)
                found = [x[e - c : e].astype(np.float32).tobytes() for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("_id").cast(pa.string()), batch.column("_quality").cast(pa.int32()), pa.array(found, pa.binary())], names=["id", "quality", "x"])

    sample = sorted(rows.mapInArrow(run, "id string, quality int, x binary").collect(), key=lambda r: (r.id, r.quality, r.x))
    sample = [(np.frombuffer(bytes(r.x), dtype=np.float32).reshape(-1, len(NAMES)), r.quality) for r in sample[:max_docs]]
    if not sample:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0, dtype=np.int64), np.zeros(0))
    return fit(np.vstack([x for x, _ in sample]).astype(np.float64), np.array([len(x) for x, _ in sample]), np.array([q for _, q in sample]))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (all columns of the input) and score of each row; null and empty texts count as one empty line."""
    bound_batches(docs.sparkSession)
    whole = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(score_batch(model, batch.column("text").to_pylist()))], names=["row", "score"])

    return whole.mapInArrow(run, whole.select("row", F.lit(0.0).alias("score")).schema)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns plus _score, which replaces an input column of that name. Null and empty texts count as one
    empty line, repeated rows each get their score, and an empty table stays empty."""
    return scored(docs, model, text_col).select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "_score"], F.col("score").alias("_score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The input's rows and columns (any names) without the documents that score below the threshold. Null texts are
    scored as empty ones; rows that repeat a doc_id are judged each by its own text."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
