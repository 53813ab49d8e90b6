"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.embed import dot


def score(vectors: DataFrame, query: list[float], where: Column | None = None) -> DataFrame:
    """vectors with score; the filter comes before any arithmetic."""
    some = vectors if where is None else vectors.where(where)
    return some.withColumn("score", F.round(dot("embedding", F.lit([float(x) for x in query]).cast("array<double>")), 6))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    return score(vectors, query, where).orderBy(F.desc("score"), id_col).limit(k)


#: Vectors of a block of queries, and scores that a worker has at once.
BLOCK, SCORES = 4096, 1 << 20


def _blocks(queries: DataFrame, id_col: str, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of the queries in counted blocks of about `block`: what the driver and a worker hold of them."""
    qs = queries.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("q"), "embedding")
    parts = -(-qs.count() // block) or 1
    for p in range(parts):
        own = qs.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == p).collect()
        yield np.array([r["q"] for r in own], np.int64), np.array([r["embedding"] for r in own], np.float64).reshape(len(own), -1)


def _pieces(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """ids and vectors of Arrow batches, in pieces of so many rows that the scores of all queries fit."""
    step = max(1, SCORES // max(1, queries))
    for b in batches:
        for k in range(0, b.num_rows, step):
            c = b.slice(k, step)
            yield c.column(0).to_numpy(), c.column(1).flatten().to_numpy().astype(np.float64).reshape(c.num_rows, -1)


def _vectors(vectors: DataFrame, id_col: str) -> DataFrame:
    return vectors.where(F.col("embedding").isNotNull()).select(F.col(id_col).cast("long"), "embedding")


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """query_id, id, score, rank: the k nearest of every query, itself excluded.

    Queries are taken in blocks: a matrix product per piece of an Arrow batch, of which only what beats a query's best k of the
    task so far is kept; then one rank over the best of all tasks.
    """
    out = None
    for ids, mat in _blocks(queries, id_col, block):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, mat: np.ndarray = mat) -> Iterator[pa.RecordBatch]:
            if not len(ids):
                return
            q, i, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # the best so far: row of the query, id, score
            least = np.full(len(ids), -np.inf)
            for v, x in _pieces(batches, len(ids)):
                got = np.round(mat @ x.T, 6)
                row, at = np.nonzero((got >= least[:, None]) & np.isfinite(got) & (ids[:, None] != v[None, :]))
                q, i, s = np.r_[q, row], np.r_[i, v[at]], np.r_[s, got[row, at]]
                order = np.lexsort((i, -s, q))
                q, i, s = q[order], i[order], s[order]
                place = np.arange(len(q)) - np.searchsorted(q, q)
                least[q[place == k - 1]] = s[place == k - 1]
                q, i, s = q[place < k], i[place < k], s[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(i), pa.array(s)], names=["query_id", "id", "score"])

        got = _vectors(vectors, id_col).mapInArrow(run, "query_id long, id long, score double")
        out = got if out is None else out.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs_within(vectors: DataFrame, queries: DataFrame, least: float, id_col: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """query_id, id, score of the pairs with a score of `least` or more, a vector with itself excluded.

    A matrix product finds the pairs, with room for its rounding; their scores are then summed in the order of the dimensions, as dot() does.
    """
    out = None
    for ids, mat in _blocks(queries, id_col, block):

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, mat: np.ndarray = mat) -> Iterator[pa.RecordBatch]:
            for v, x in _pieces(batches, len(ids)):
                if not len(ids):
                    return
                row, at = np.nonzero((mat @ x.T >= least - 1e-5) & (ids[:, None] != v[None, :]))
                score = np.zeros(len(row))
                for a, b in zip(mat.T, x.T, strict=True):
                    score += a[row] * b[at]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(v[at]), pa.array(score)], names=["query_id", "id", "score"])

        got = _vectors(vectors, id_col).mapInArrow(run, "query_id long, id long, score double")
        out = got if out is None else out.unionByName(got)
    return out.withColumn("score", F.round("score", 6)).where(F.col("score") >= least)
