"""Vector search: exact, in blocks, and by an index of cells around centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.storage import stage

QUERIES_PER_BLOCK, ROWS_PER_BLOCK = 1024, 8192
#: Most rows that centroids are fitted on, and most centroids.
MOST_FITTED, MOST_CELLS = 20_000, 4096


def _norm(c: str) -> Column:
    return F.coalesce(F.sqrt(F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(0.0))


def _unit(vectors) -> np.ndarray:
    m = np.asarray(vectors, np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


@dataclass
class Index:
    """cells: (cell, part, ids, values): every row of the index once, packed by cell in parts of about ROWS_PER_BLOCK; about: one row, what it was built of."""

    centroids: np.ndarray
    cells: DataFrame
    about: DataFrame
    key: str


def build_index(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, rounds: int = 10) -> Index:
    """An index over every row: centroids are fitted on a sample of at most MOST_FITTED rows, by a hash of the key, then each row is put into its nearest cell.

    Null, empty and zero vectors are left out and counted. All vectors must have the same length.
    """
    spark = rows.sparkSession
    there = rows.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(_norm("v") > 0)
    n = there.count()
    share = 1.0 if n <= MOST_FITTED else MOST_FITTED / n
    sample = there.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(MOST_FITTED).toPandas()["v"] if n else []
    k = min(cells or max(1, int(np.sqrt(n))), MOST_CELLS, max(1, len(sample) // 2))
    x = _unit(list(sample)) if n else np.zeros((1, 1))
    centroids = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = np.linalg.norm(sums, axis=1) > 0
        centroids[filled] = _unit(sums[filled])
    shared = spark.sparkContext.broadcast(centroids)  # at most MOST_CELLS vectors
    kind = rows.schema[key].dataType.simpleString()

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(cell=(_unit(b["v"].tolist()) @ shared.value.T).argmax(axis=1))

    placed = there.mapInPandas(put, f"id {kind}, v array<double>, cell int")
    placed = stage(placed, "placed")
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / ROWS_PER_BLOCK).alias("parts"))
    packed = placed.join(F.broadcast(sizes), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    packed = stage(packed.agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("values")), "cells")
    about = rows.agg(F.count("*").alias("n_rows"), F.lit(n).cast("long").alias("n_indexed"), F.max(F.size(vector)).alias("dim"), F.lit(len(centroids)).alias("n_cells"))
    return Index(centroids, packed, about, key)


def save_index(index: Index, path: str) -> None:
    """The index as three tables: cells, centroids in order, and what it was built of."""
    spark = index.cells.sparkSession
    index.cells.write.parquet(f"{path}/cells")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(index.centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    index.about.coalesce(1).write.parquet(f"{path}/about")


def load_index(spark: SparkSession, path: str, key: str = "vec_id") -> Index:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").limit(MOST_CELLS).collect()
    return Index(np.array([r["centroid"] for r in rows]), spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/about"), key)


def search(index: Index, queries: DataFrame, k: int = 10, probes: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, rank, similarity): each query's k best rows of the ``probes`` nearest cells, itself left out; ties go to the smaller key."""
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index.centroids)
    kind = queries.schema[key].dataType.simpleString()
    asked = queries.select(F.col(key).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(_norm("q") > 0)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(b["q"].iloc[0]) == shared.value.shape[1]:
                sim = _unit(b["q"].tolist()) @ shared.value.T
                best = np.argsort(-sim, axis=1, kind="stable")[:, :probes]
                yield b.assign(cell=list(best.astype(np.int32)))

    probed = asked.mapInPandas(near, f"query_id {kind}, q array<double>, cell array<int>").withColumn("cell", F.explode("cell"))
    spread = F.pmod(F.xxhash64("query_id"), F.lit(1 << 20))
    parts = probed.groupBy("cell", F.floor(spread / F.lit(1 << 10)).alias("slice")).agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("q")).alias("wanted"))
    both = parts.join(index.cells, "cell")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                ids, asked = np.asarray(x.ids), np.asarray(x.asked)
                yield _top(asked, _unit(np.asarray(x.wanted).reshape(len(asked), -1)), ids, _unit(np.asarray(x.values).reshape(len(ids), -1)), k, index_key)

    index_key = index.key
    found = both.mapInPandas(best, f"query_id {kind}, `{index_key}` {kind}, similarity double").withColumn("similarity", F.round("similarity", 6))
    top = Window.partitionBy("query_id").orderBy(F.desc("similarity"), index_key)
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", index_key, "rank", "similarity")


def tuned_probes(index: Index, rows: DataFrame, k: int = 10, target: float = 0.95, asked: int = 100, key: str = "vec_id", vector: str = "embedding") -> int:
    """The least number of probes, doubling from 4, with which ``asked`` rows, drawn by a hash, find that share of their exact k nearest.

    Vectors without clusters need most of the cells; then the exact search is as good.
    """
    some = stage(rows.where(_norm(vector) > 0).orderBy(F.xxhash64(key), key).limit(asked), "asked")
    exact = stage(nearest(rows, some, k, key, vector), "exact")
    probes, every = 4, len(index.centroids)
    while probes < every and (recall(search(index, some, k, probes, key, vector), exact, k, key).first()["recall_at_k"] or 0.0) < target:
        probes *= 2
    return min(probes, every)


def _top(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, m: np.ndarray, k: int, key: str) -> pd.DataFrame:
    """Each query's rows that reach its k-th best similarity, so that ties are settled by key later."""
    sim = q @ m.T
    sim[asked[:, None] == ids[None, :]] = -np.inf
    cut = np.partition(sim, max(0, sim.shape[1] - k), axis=1)[:, max(0, sim.shape[1] - k)] - 1e-9
    i, j = np.nonzero((sim >= cut[:, None]) & np.isfinite(sim))
    return pd.DataFrame({"query_id": asked[i], key: ids[j], "similarity": sim[i, j]})


def recall(found: DataFrame, exact: DataFrame, k: int = 10, key: str = "vec_id") -> DataFrame:
    """One row (queries, recall_at_k, mrr_at_k): the share of the exact k that is found, and the mean inverse rank at which the exact best one is."""
    e = exact.where(F.col("rank") <= k)
    hit = e.select("query_id", key, F.col("rank").alias("true_rank")).join(found.select("query_id", key, "rank"), ["query_id", key], "left")
    per = hit.groupBy("query_id").agg((F.count("rank") / F.count("*")).alias("r"), F.max(F.when(F.col("true_rank") == 1, 1 / F.col("rank"))).alias("m"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("r"), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce("m", F.lit(0.0))), 6).alias("mrr_at_k"))


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, rank, similarity): each query's k rows of greatest cosine similarity, itself left out; ties go to the smaller key.

    Rows and queries are packed in blocks, every block of rows meets every block of queries once, and a matrix product keeps each
    query's k best of the block; the rest is a ranking. Null, empty and zero vectors are neither found nor asked.
    """
    kind = rows.schema[key].dataType.simpleString()

    def packed(df: DataFrame, size: int, prefix: str) -> DataFrame:
        there = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where(_norm("v") > 0)
        many = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.lit(df.count()) / size)).cast("long"))
        return there.groupBy(many.alias(f"{prefix}_block")).agg(F.collect_list("id").alias(f"{prefix}_ids"), F.flatten(F.collect_list("v")).alias(f"{prefix}_values"))

    # every block of rows with every block of queries: the queries' number of blocks is known, and each block of rows is sent to all of them
    asked = packed(queries, QUERIES_PER_BLOCK, "q")
    blocks = max(1, -(-queries.count() // QUERIES_PER_BLOCK))
    both = packed(rows, ROWS_PER_BLOCK, "r").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(asked, "q_block")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x in b.itertuples(index=False):
                ids, asked = np.asarray(x.r_ids), np.asarray(x.q_ids)
                m, q = (_unit(np.asarray(v, np.float64).reshape(len(i), -1)) for v, i in ((x.r_values, ids), (x.q_values, asked)))
                yield _top(asked, q, ids, m, k, key)

    found = both.mapInPandas(best, f"query_id {kind}, `{key}` {kind}, similarity double").withColumn("similarity", F.round("similarity", 6))
    top = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("query_id", key, "rank", "similarity")
