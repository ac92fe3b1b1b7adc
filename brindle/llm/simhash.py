"""Near duplicates by SimHash fingerprints, through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that, of two fingerprints that differ in at most
`max_bits` bits, one segment differs in at most one bit (two segments for two bits). A segment is
indexed under each of its variants with one bit masked out, so such a segment of two fingerprints
has a variant in common. The index is an equality join on (segment, masked bit, rest):

* only distinct fingerprints are indexed, so exact and very near copies are one row;
* a signature that two or three fingerprints share gives its pairs from the minimum, the maximum
  and the XOR of its members, which are map-side combined: a signature's members never come together;
* a signature with more members (a large group of copies whose halves agree) is not expanded into
  pairs. Its members get a second round of longer signatures: what is left without `max_bits` of the eight bytes;
* members of signatures that are still large go on to points: each emits itself and its 64 one-bit
  neighbours. Two of them differ in at most two bits if and only if they share a point, and a point has 65 members
  at most, all within two bits of each other, so linking each to the smallest of the point loses no connection.

All candidate pairs are verified by their differing bits before they count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import bound_batches, checkpointed, compact, lit_array, table, texts
from brindle.llm.components import connected_components

MAX_BITS = 2
SHINGLE_WORDS = 3
SEED = 42
BITS = 64
#: Bytes of text that are split into words at a time, whatever the length of the text.
BLOCK = 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints whose signatures one task makes.
TASK_ROWS = 1 << 14
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_blocks(raw: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased (A-Z), in lists from some `size` bytes each."""
    at = 0
    while at < len(raw):
        space = SPACE.search(raw, at + size)
        end = space.start() if space else len(raw)
        yield raw[at:end].translate(LOWER).split()
        at = end


def shingle_hashes(words: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of k words, joined by spaces; of all words where there are fewer, but some."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[k - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))


def fingerprint(raw: bytes | None) -> int:
    """Bit b is set if over half of the shingle hashes have it; 0 for a text without words."""
    ones, total, kept = np.zeros(BITS, np.int64), 0, []
    for words in word_blocks(raw or b""):
        if not words:
            continue
        both = kept + words  # the shingles that cross from block to block
        if len(both) >= SHINGLE_WORDS:
            h = shingle_hashes(both)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(h)
        kept = both[-(SHINGLE_WORDS - 1) :]
    if kept and not total:
        return int(shingle_hashes(kept)[0])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a long. `docs` has doc_id and text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("text").cast(pa.binary())
            found = np.array([fingerprint(t.as_py()) for t in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


def segment_masks(max_bits: int) -> list[int]:
    """Bits that the one-wildcard variants of all segments keep."""
    segments = max_bits // 2 + 1
    edges = [BITS * s // segments for s in range(segments + 1)]
    return [((1 << high) - 1) ^ ((1 << low) - 1) ^ (1 << bit) for low, high in zip(edges, edges[1:]) for bit in range(low, high)]


def byte_masks(max_bits: int) -> list[int]:
    """Bits that remain without `max_bits` of the bytes."""
    return [(1 << BITS) - 1 - sum(0xFF << 8 * b for b in gone) for gone in combinations(range(BITS // 8), max_bits)]


def with_each(fps: DataFrame, bits: list[int], name: str) -> DataFrame:
    """fp beside each of these 64-bit numbers: a constant list, so the generated code stays small."""
    return fps.select("fp", F.explode(lit_array([b - (1 << BITS) if b >> BITS - 1 else b for b in bits], "bigint")).alias(name))


def signatures(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp and a 64-bit hash of each mask with what it leaves of fp."""
    return with_each(fps, masks, "mask").select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("sig"))


def differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def ordered_pair(a: Column | str, b: Column | str) -> Column:
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def point_links(fps: DataFrame) -> DataFrame:
    """Pairs that connect all of `fps` within two bits of each other: members of a point with its smallest member."""
    points = with_each(fps, [0, *[1 << b for b in range(BITS)]], "flip").select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least < most").select("point", "least")
    return points.join(least, "point").where("fp <> least").select(ordered_pair("fp", "least").alias("p")).select("p.*")


def few_and_crowd(fps: DataFrame, masks: list[int]) -> tuple[DataFrame, DataFrame | None]:
    """Pairs that connect the members of signatures that two or three have; the distinct members of larger ones, if any."""
    sigs = signatures(fps.repartition(1 + fps.count() // TASK_ROWS), masks)
    tally = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.bit_xor("fp").alias("odd"))
    shared = compact(tally.where("size > 1"))
    middle = F.col("odd").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    third = F.when(F.col("size") == 3, F.array(ordered_pair("lo", middle), ordered_pair(middle, "hi"))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    pairs = shared.where("size <= 3").select(F.explode(F.concat(F.array(ordered_pair("lo", "hi")), third)).alias("p")).select("p.*")
    large = shared.where("size > 3").select("sig")
    return pairs, None if large.isEmpty() else compact(sigs.join(large, "sig", "left_semi").select("fp").distinct(), rows=TASK_ROWS)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Verified pairs (a < b) of distinct fingerprints; each that has another within `max_bits` bits is connected to it, directly or by others."""
    pairs, crowd = few_and_crowd(fps, segment_masks(max_bits))
    if crowd:
        more, crowd = few_and_crowd(crowd, byte_masks(max_bits))
        pairs = pairs.union(more)
    if crowd:
        pairs = pairs.union(point_links(crowd))
    return pairs.where("a < b").where(differing("a", "b") <= max_bits).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links of at most `max_bits` bits).

    Null text counts as empty; texts without words have fingerprint zero and link like others. Rows without doc_id
    take part in linking; a component made of them only has no component_id. Rows that repeat a doc_id keep a row
    each, with the component of their own text. No other column is read, and an empty table gives no rows. Texts of any length are read
    whole, a block at a time.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("signatures with one wildcard and points of one flip serve up to two differing bits")
    bound_batches(docs.sparkSession, rows=1000, size=4 << 20)
    marked = checkpointed(fingerprints(texts(docs, id_col, text_col)))
    owners = compact(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    links = fingerprint_links(owners.select("fp"), max_bits) if max_bits else owners.where("false").select(F.col("fp").alias("a"), F.col("fp").alias("b"))
    comp = connected_components(links)
    linked = owners.join(comp, owners.fp == comp.node, "left").select("fp", "least", "rows", F.coalesce("component", "fp").alias("part"), F.col("component").isNotNull().alias("linked"))
    firsts = linked.where("linked").groupBy("part").agg(F.min("least").alias("first"))
    # only fingerprints with another row than the one document need the way back to the documents
    shared = linked.where("linked OR rows > 1").join(firsts, "part", "left").select("fp", F.coalesce("first", "least").alias("component_id"), F.lit(True).alias("shared"))
    return marked.join(compact(shared), "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
