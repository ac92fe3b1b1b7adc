"""A stored dense index: vectors in cells around centroids, scored exactly within the cells that a query probes.

Centroids are fitted on a bounded sample; every vector is stored, in the cell of its nearest centroid. A cell of any size is
searched in blocks: each block of vectors meets each block of queries in one task as a matrix product,
and passes on the best `k` of each query only. Probing all cells is an exact search, by which recall is measured.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import layers
from brindle.operators.search import DENSE_LEAST

CELLS = 64
#: Vectors that centroids are fitted on, those with the smallest hashes of their ids, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 12
#: Sampled queries by which the number of probes is chosen.
TUNING = 200
#: Vectors and queries that one task multiplies.
BLOCK, QUERY_BLOCK = 8192, 2048
#: Rows that placing gives, and scores that a task holds, at a time: some 8 MB each.
PLACED, SCORED = 1 << 14, 1 << 20
#: Texts that are encoded at a time.
ENCODED = 64


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays."""
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(norm == 0, 1, norm)


def _matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def fit_centroids(v: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit vectors, by spherical k-means; as many as there are distinct vectors at most."""
    v = np.unique(v, axis=0)
    c = v[np.random.default_rng(seed).permutation(len(v))[:cells]]
    for _ in range(rounds):
        near = (v @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        c = np.where((total * total).sum(axis=1, keepdims=True) > 0, unit_rows(total), c)
    return c


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector (doubles) of rows whose vector is there and has finite entries only."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)


def placed(batch: pa.RecordBatch, centroids: np.ndarray, cells: int) -> Iterator[pa.RecordBatch]:
    """id, v and cell for each of the `cells` nearest cells of each row; PLACED rows at a time, however many cells there are."""
    dims, step = centroids.shape[1], max(1, PLACED // cells)
    for first in range(0, batch.num_rows, step):
        part = batch.slice(first, step)
        v = _matrix(part.column("v"), dims)
        score = unit_rows(v) @ centroids.T
        near = np.argpartition(-score, cells - 1, axis=1)[:, :cells]
        at = np.repeat(np.arange(len(v)), cells)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(v[at].ravel()), dims).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(at)), lists, pa.array(near.ravel().astype(np.int32))], names=["id", "v", "cell"])


def _with_cells(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """id, v and cell: a row for each of the `probes` nearest cells."""
    kind, cells = rows.schema["id"].dataType.simpleString(), min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from placed(batch, centroids, cells)

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, cell int")


def build_vectors(vectors: DataFrame, path: str, id_col: str = "vec_id", vector_col: str = "embedding", cells: int = CELLS, recall: float = 0.95, k: int = 10) -> layers.Store:
    """Stores all vectors of one length (the most frequent; unique ids). Rows without a usable vector are left out. The number of probes that
    searches use by default is the least that finds `recall` of the exact best `k` of a sample of the vectors."""
    spark = vectors.sparkSession
    try:
        version = layers.open_store(spark, path).version + 1
    except layers.Missing:
        version = 1
    rows = clean(vectors, id_col, vector_col)
    size = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if size is None:
        layers.put(rows.withColumn("cell", F.lit(0)), path, "vectors", version)
        layers.put(spark.createDataFrame([], "cell int, centroid array<double>, n bigint"), path, "cells", version)
        return layers.commit(spark, path, version, version, engine="dense", dims=0, n=0, probes=1)
    rows = rows.where(F.size("v") == size.dims)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()  # bounded
    centroids = fit_centroids(unit_rows(_matrix(sample.column("v"), size.dims)), cells)
    kind = vectors.schema[vector_col].dataType
    placed = _with_cells(rows, centroids, 1).select("id", F.col("v").cast(kind).alias("v"), "cell")
    layers.put(placed.repartitionByRange("cell", "id").sortWithinPartitions("cell"), path, "vectors", version)
    stored = spark.read.parquet(f"{path}/vectors/version={version}")
    counts = {r.cell: r["count"] for r in stored.groupBy("cell").count().collect()}  # a row per cell
    table = [(c, centroids[c].tolist(), counts.get(c, 0)) for c in range(len(centroids))]
    layers.put(spark.createDataFrame(table, "cell int, centroid array<double>, n bigint").coalesce(1), path, "cells", version)
    now = layers.Store(spark, path, version, version, {"engine": "dense", "dims": size.dims, "n": sum(counts.values()), "probes": len(centroids)})
    return layers.commit(spark, path, version, version, **now.facts | {"probes": _tuned(now, recall, k)})


def _tuned(store: layers.Store, recall: float, k: int) -> int:
    """The least number of probes that reaches `recall`, and 0.02 more where possible, on a bounded sample of the stored vectors, each asked for its neighbours."""
    asked = store.latest("vectors").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(TUNING).select("id", "v")
    exact = search_vectors(store, asked, k, None, -2.0, "id", "v")
    centroids, _ = _cells(store)
    place = store.latest("vectors").select(F.col("id").alias("hit"), "cell")
    rows = exact.join(place, "hit").join(asked.select("id", "v"), "id").select("id", "v", "cell").toArrow()  # TUNING * k rows
    score = unit_rows(_matrix(rows.column("v"), store.facts["dims"])) @ centroids.T
    cell = rows.column("cell").to_numpy()
    rank = (score > score[np.arange(len(cell)), cell][:, None]).sum(axis=1)  # cells that are probed before the one with the hit
    return int(np.sort(rank)[min(len(rank) - 1, int(np.ceil(recall * len(rank))) - 1 + len(rank) // 50)]) + 1


def _cells(store: layers.Store) -> tuple[np.ndarray, dict[int, int]]:
    rows = store.latest("cells").orderBy("cell").collect()  # bounded by the number of cells
    return np.array([r.centroid for r in rows]), {r.cell: r.n for r in rows}


def search_vectors(store: layers.Store, queries: DataFrame, k: int = 10, probes: int | None = 0, least: float = DENSE_LEAST, id_col: str = "vec_id", vector_col: str = "embedding", where: DataFrame | None = None) -> DataFrame:
    """id (of the query), hit, score and place of the best `k` stored vectors of each query by cosine, at least `least`, ties by hit.

    `probes`: cells that a query looks into; 0: as the store was tuned; None: all, which is exact. `where` (id) restricts the stored
    vectors before scoring. Queries without a usable vector, or of another length, have no hits. A query's own vector is a hit like others.
    """
    spark, dims = store.spark, store.facts["dims"]
    kind = store.latest("vectors").schema["id"].dataType.simpleString()
    asked = clean(queries, id_col, vector_col).where(F.size("v") == dims)
    query_kind = asked.schema["id"].dataType.simpleString()
    schema = f"id {query_kind}, hit {kind}, score double"
    centroids, sizes = _cells(store)
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, place int")
    probing = _with_cells(asked, centroids, len(centroids) if probes is None else min(probes or store.facts["probes"], len(centroids)))
    per_cell = {r.cell: r["count"] for r in probing.groupBy("cell").count().collect()}  # a row per cell
    plan = [(c, max(1, -(-sizes[c] // BLOCK)), max(1, -(-n // QUERY_BLOCK))) for c, n in per_cell.items()]
    blocks = F.broadcast(spark.createDataFrame(plan, "cell int, blocks int, query_blocks int"))  # bounded by the number of cells
    part = lambda id_, n: F.pmod(F.xxhash64(id_), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = store.latest("vectors") if where is None else store.latest("vectors").join(where, "id", "left_semi")
    left = probing.join(blocks, "cell").select("id", "v", "cell", every("blocks").alias("block"), part("id", "query_blocks").alias("query_block"))
    right = stored.join(blocks, "cell").select(F.col("id").alias("hit"), "v", "cell", part("id", "blocks").alias("block"), every("query_blocks").alias("query_block"))
    keys = ["cell", "block", "query_block"]

    def best(q: pa.Table, s: pa.Table) -> pa.Table:
        empty = pa.table({"id": q.column("id").slice(0, 0), "hit": s.column("hit").slice(0, 0), "score": pa.array([], pa.float64())})
        if not (q.num_rows and s.num_rows):
            return empty
        ids = s.column("hit").combine_chunks()
        order = pa.compute.array_sort_indices(ids).to_numpy()  # ties go to the smaller id
        asked_by, of = q.column("id").combine_chunks(), unit_rows(_matrix(q.column("v"), dims))
        to = unit_rows(_matrix(s.column("v"), dims))[order]
        out, step = [empty], max(1, SCORED // len(to))
        for first in range(0, len(of), step):
            score = np.round(of[first : first + step] @ to.T, 6)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            row = np.repeat(np.arange(len(score)), top.shape[1])
            value = score[row, top.ravel()]
            ok = value >= least
            out.append(pa.table({"id": asked_by.take(pa.array(first + row[ok])), "hit": ids.take(pa.array(order[top.ravel()][ok])), "score": pa.array(value[ok])}))
        return pa.concat_tables(out)

    found = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "hit"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def recall_of(store: layers.Store, queries: DataFrame, k: int = 10, probes: int = 0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: queries, exact (hits of the exact search), found (those that the probing search finds too), recall."""
    exact, some = (search_vectors(store, queries, k, p, -2.0, id_col, vector_col).select("id", "hit", "score") for p in (None, probes))
    both = exact.join(some.select("id", "hit", F.lit(1).alias("f")), ["id", "hit"], "left")
    return both.agg(F.countDistinct("id").alias("queries"), F.count(F.lit(1)).alias("exact"), F.count("f").alias("found")).withColumn("recall", F.col("found") / F.col("exact"))


# ---------------------------------------------------------------- texts


def encoded(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """vec_id and embedding of each text, encoded some 64 at a time; an empty or null text as one space."""
    rows = docs.select(F.col(id_col).alias("vec_id"), F.coalesce(F.nullif(text_col, F.lit("")), F.lit(" ")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODED):
                part = batch.slice(at, ENCODED)
                v = unit_rows(np.asarray(encode(part.column("text").to_pylist()), np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(list(v), pa.list_(pa.float32()))], names=["vec_id", "embedding"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, embedding array<float>")


def build_search(docs: DataFrame, path: str, encode: Callable[[list[str]], np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text") -> layers.Store:
    """A dense index where an encoder is given, else a TF-IDF index; the head says which."""
    from brindle.operators import stored_index

    return build_vectors(encoded(docs, encode, id_col, text_col), path) if encode else stored_index.build_index(docs, path, id_col, text_col)


def search_text(spark: SparkSession, path: str, query: str, k: int = 5, encode: Callable[[list[str]], np.ndarray] | None = None, least: float | None = None) -> DataFrame:
    """doc_id, score and engine of the best documents, by the engine that the stored head names; one row with an error where nothing is
    stored, or where a dense index is asked without an encoder."""
    from brindle.operators import stored_index

    try:
        store = layers.open_store(spark, path)
        if store.facts.get("engine") != "dense":
            found = stored_index.search_store(store, query, k, *([] if least is None else [least]))
            return found.select("doc_id", "score", F.lit("tfidf").alias("engine"), F.lit(None).cast("string").alias("error"))
        if encode is None:
            raise layers.Missing("the index is dense: give the encoder it was built with")
    except layers.Missing as e:
        return spark.createDataFrame([(None, None, None, str(e))], "doc_id long, score double, engine string, error string")
    asked = spark.createDataFrame([(0, [float(x) for x in np.asarray(encode([query or " "]))[0]])], "vec_id int, embedding array<double>")
    hits = search_vectors(store, asked, k, 0, DENSE_LEAST if least is None else least)
    return hits.select(F.col("hit").alias("doc_id"), F.round("score", 4).alias("score"), F.lit("dense").alias("engine"), F.lit(None).cast("string").alias("error"))
