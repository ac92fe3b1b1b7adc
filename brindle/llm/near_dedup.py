"""Near-duplicate documents by ProbMinHash over weighted word shingles.

1. One pass names each document's word sequence by a digest and computes its ProbMinHash signature: the
   arrivals of one Poisson process per shingle (rate: its weight) fall into random registers, the
   earliest arrival of each register wins, and a process stops once it is later than every register. Two
   registers agree with the probability Jaccard similarity. Where shingles repeat, a second signature with all
   weights 1 does the same for the set Jaccard.
2. Equal word sequences become one node. Nodes that share a band of registers are candidates: all pairs of a
   small bucket; in a larger one each member with the bucket's most central member. Members of a large bucket that
   are not one component by then get longer bands, and what is still apart in a large bucket of those an exact
   prefix join of its shingles.
3. Candidates are verified on their whole shingle sets.
4. Components of verified links are the classes; the smallest doc_id of a class stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.candidates import bucket_pairs, in_cells, whole_components
from brindle.llm.common import bound_batches, checkpointed, compact, table
from brindle.llm.decontaminate import words

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares one of the first round's bands with probability 0.9998.
BANDS, ROWS = 16, 4
#: Bands of the second round, for nodes of unsettled large buckets: 0.9994 at 0.8, but 0.14 at 0.5.
LONG_BANDS, LONG_ROWS = 40, 8
#: Words whose hashes a task remembers, some 20 MB.
WORD_MEMORY = 100_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) < WORD_MEMORY:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]], hashes: WordHashes, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle hash and weight (occurrences) of the distinct shingles of each text, sorted.

    A text of fewer words than a shingle has is one shingle; one without words has none.
    """
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.fromiter((hashes[w] for t in texts for w in t), dtype=np.uint64, count=int(counts.sum()))
    starts = np.cumsum(counts) - counts
    n = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(texts)), n)
    first = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = np.full(len(doc), width, dtype=np.uint64)
    ends = (starts + counts)[doc]
    for k in range(width):
        at = first + k
        word = np.where(at < ends, flat[np.minimum(at, max(len(flat) - 1, 0))] if len(flat) else 0, np.uint64(0))
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + word)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Signatures, n_docs x registers: the winning shingle of each register (0 without shingles).

    Round i draws the i-th arrival of every process that is still earlier than its document's latest register.
    """
    best = np.full(n_docs * registers, np.inf)
    won = np.zeros(n_docs * registers, dtype=np.uint64)
    time, rnd = np.zeros(len(doc)), 0
    d, s, w = doc, h, weight.astype(np.float64)
    while len(d):
        rnd += 1
        draw = mix(s + np.uint64(rnd * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log(((draw >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / w
        at = d * registers + (draw & np.uint64(0xFFF)).astype(np.int64) * registers // 4096
        early = time < best[at]
        np.minimum.at(best, at[early], time[early])
        win = early & (time == best[at])
        won[at[win]] = s[win]
        alive = time < best.reshape(n_docs, registers).max(axis=1)[d]
        d, s, w, time = d[alive], s[alive], w[alive], time[alive]
    return won.reshape(n_docs, registers)


def bands(signed: np.ndarray, n: int, rows: int) -> np.ndarray:
    """A signed 64-bit key for each of `n` bands of each signature."""
    signed = signed.reshape(len(signed), n, rows)
    key = np.broadcast_to(np.arange(n, dtype=np.uint64), (len(signed), n)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, k])
    return key.view(np.int64)


def both_bands(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int, n: int, rows: int) -> list[list[int]]:
    """The bands of each document's signature, and those of the same with all weights 1, which propose by set Jaccard.

    The draws are the same, so a document without repeated shingles has the same bands twice; they are listed once.
    """
    found = bands(prob_minhash(doc, h, weight, n_docs, n * rows), n, rows).tolist()
    repeats = np.zeros(n_docs, dtype=bool)
    repeats[doc[weight > 1]] = True
    if repeats.any():
        at, which = repeats[doc], np.cumsum(repeats) - 1
        plain = bands(prob_minhash(which[doc[at]], h[at], np.ones(int(at.sum())), int(repeats.sum()), n * rows), n, rows).tolist()
        for i, more in zip(np.flatnonzero(repeats), plain, strict=True):
            found[i] = list(dict.fromkeys(found[i] + more))
    return found


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Set Jaccard and probability Jaccard of two sorted shingle arrays with weights."""
    every = np.union1d(a[0], b[0])
    if not len(every):
        return 0.0, 0.0
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a[0])] = a[1]
    y[np.searchsorted(every, b[0])] = b[1]
    both = np.flatnonzero((x > 0) & (y > 0))
    if not len(both):
        return 0.0, 0.0
    # max(x'/x, y'/y) is x'/x where x'/y' >= x/y: sort by that ratio and sum from either end
    with np.errstate(divide="ignore"):
        ratio = x / y
    order = np.argsort(ratio, kind="stable")
    above, below = np.append(np.cumsum(x[order][::-1])[::-1], 0.0), np.append(0.0, np.cumsum(y[order]))
    first = np.searchsorted(ratio[order], ratio[both], side="left")
    return len(both) / len(every), float((1.0 / (above[first] / x[both] + below[first] / y[both])).sum())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node (digest of the word sequence; of the raw text where there are no words), buckets (one per band of either signature).

    `docs` has doc_id and text. A text without words has no buckets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [words(t) for t in raw]
            doc, h, weight = shingles(texts, hashes)
            key = both_bands(doc, h, weight, len(texts), BANDS, ROWS)
            node = [digest(t, r) for t, r in zip(texts, raw, strict=True)]
            buckets = [k if t else [] for k, t in zip(key, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(node, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], names=["doc_id", "node", "buckets"])

    return docs.mapInArrow(run, f"doc_id {kind}, node binary, buckets array<bigint>")


def digest(ws: list[bytes], raw: bytes | None) -> bytes:
    return hashlib.blake2b(b" ".join(ws), digest_size=16).digest() if ws else hashlib.blake2b(raw or b"", digest_size=16, person=b"raw").digest()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """node, its distinct shingles (sorted 64-bit numbers) and their weights, as packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            texts = [words(t) for t in raw]
            doc, h, weight = shingles(texts, hashes)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            sets = [h[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            weights = [weight[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([digest(t, r) for t, r in zip(texts, raw, strict=True)], pa.binary()), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], names=["node", "set", "weights"])

    return docs.mapInArrow(run, "node binary, set binary, weights binary")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between the nodes of each pair of keys whose set or probability Jaccard reaches the threshold. `sets`: key, node, set, weights."""
    left, right = (sets.select(F.col("key").alias(n), F.struct("node", "set", "weights").alias(f"s{n}")) for n in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = lambda s: (np.frombuffer(s["set"], dtype=np.uint64), np.frombuffer(s["weights"], dtype="<u4"))
        for batch in batches:
            both = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            ok = [(x["node"], y["node"]) for x, y in both if max(jaccard(unpack(x), unpack(y))) >= similarity]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in ok], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("sa", "sb").mapInArrow(run, "a binary, b binary")


def longer_bands(sets: DataFrame) -> DataFrame:
    """key and second-round bucket of each packed shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h = [np.frombuffer(s, dtype=np.uint64) for s in batch.column("set").to_pylist()]
            w = [np.frombuffer(s, dtype="<u4") for s in batch.column("weights").to_pylist()]
            doc = np.repeat(np.arange(len(h)), [len(x) for x in h])
            # other draws than in the first round
            found = both_bands(doc, mix(np.concatenate(h)), np.concatenate(w), len(h), LONG_BANDS, LONG_ROWS)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], names=["key", "buckets"])

    return sets.select("key", "set", "weights").mapInArrow(run, "key bigint, buckets array<bigint>").select("key", F.explode("buckets").alias("bucket"))


def weighted_items(sets: DataFrame) -> DataFrame:
    """node, token and weight: one row for each shingle of a packed set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [np.frombuffer(s, dtype="<i8") for s in batch.column("set").to_pylist()]
            weights = [np.frombuffer(s, dtype="<u4").astype(np.int64) for s in batch.column("weights").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(tokens, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int64()))], names=["node", "tokens", "weights"])

    rows = sets.select("node", "set", "weights").mapInArrow(run, "node binary, tokens array<bigint>, weights array<bigint>")
    return rows.select("node", F.explode(F.arrays_zip("tokens", "weights")).alias("item")).select("node", F.col("item.tokens").alias("token"), F.col("item.weights").alias("weight"))


def near_nodes(rows: DataFrame, similarity: float) -> DataFrame:
    """doc_id, node and class (a node of its component) of each row. `rows` has doc_id and text."""
    bound_batches(rows.sparkSession, rows=250, size=1 << 20)
    signed = checkpointed(signatures(rows))
    nodes = signed.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id")).alias("rep"), F.first("buckets").alias("buckets"))
    nodes = compact(nodes.select("node", F.xxhash64("node").alias("key"), F.col("rep.doc_id").alias("rep"), "buckets"))
    pairs, many = bucket_pairs(nodes.select("key", F.explode("buckets").alias("bucket")))
    need = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = compact(nodes.select("node", "key", "rep").join(need, "key", "left_semi"))
    # a node's text comes from rows of its smallest doc_id (null where it has none)
    place = lambda c: F.xxhash64(F.col(c).isNull(), c)
    found = in_cells(rows.withColumn("place", place("doc_id")), "place", wanted.withColumn("place", place("rep"))).drop("place")
    sets = shingle_sets(found).withColumn("key", F.xxhash64("node"))
    sets = compact(in_cells(sets, "key", wanted).join(wanted, ["key", "node"], "left_semi").dropDuplicates(["node"]), rows=1000)
    links = compact(verified(pairs, sets, similarity))
    of = lambda few: sets.join(few, "node", "left_semi")
    comp = whole_components(links, many, sets.select("key", "node"), lambda few: longer_bands(sets.join(few, "key", "left_semi")), lambda few: weighted_items(of(few)), lambda found: verified(found, sets, similarity), similarity)
    return signed.select("doc_id", "node").join(comp, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("class"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest doc_id of its class), class_size (rows), kept (doc_id is class_id).

    Null and empty texts, and texts without words, are alike only if their raw texts are equal (null
    counts as empty). Rows without doc_id take part in linking; a class made of them only has no class_id, and
    keeps them. Rows that repeat a doc_id are in the class of their own text. No other column is read, and an empty
    table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    labelled = compact(near_nodes(rows, similarity))
    classes = labelled.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).where("class_size > 1")
    return labelled.join(classes, "class", "left").select(
        "doc_id",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The input's rows and columns (any names), one document of each class: its smallest (doc_id, text).

    Rows without doc_id stay. Rows that repeat a doc_id with another text are documents of their own; of rows that
    repeat both one stays. An empty table stays empty.
    """
    # a text's node is a digest of its words; the mark tells texts with equal words apart
    own = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.select("row", "text", F.col("row.doc_id").alias("doc_id"), F.xxhash64("text").alias("mark"))
    ids = own.where("doc_id IS NOT NULL").select(F.struct("doc_id", "mark").alias("doc_id"), "text")
    kept = near_nodes(ids, similarity).groupBy("class").agg(F.min("doc_id").alias("keep")).select(F.col("keep.doc_id").alias("keep_id"), F.col("keep.mark").alias("keep_mark"))
    stay = own.join(kept, (F.col("doc_id") == F.col("keep_id")) & (F.col("mark") == F.col("keep_mark")), "left_semi").dropDuplicates(["doc_id", "mark"])
    return stay.select("row.*").union(own.where("doc_id IS NULL").select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))
