"""Exact top-k inner products by MaxScore over dense integer vectors.

A query term is a dimension with the sign of the query's component; its postings are the vectors whose component has that
sign, and only they gain from the term. Within a shard, terms are ordered by their score bound (largest gain of any vector in the
shard). With the k-th best score so far as threshold, the leading terms whose bounds sum to less than it are non-essential:
a vector in no essential posting list cannot reach the threshold. Essential postings are traversed, the other terms are
probed in falling order of bound while a vector can still compete, and the best k of every shard are merged.

Vectors are dealt into shards by a hash of vec_id and queries into blocks; each cell holds SHARD_ROWS vectors and
QUERY_ROWS queries on average, so memory is bounded and no cell holds all of either side. Every cell is exact, so is the merge.

Vectors that are null, or hold a null or non-finite component, take no part. Shorter vectors count as padded with 0.
Repeated rows are candidates of their own; a query never meets rows of its own vec_id; rows with a null vec_id take no part. Of
several query rows with one vec_id the one with the smallest vector is taken. Ties go to the smaller vec_id. An empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARD_ROWS = 8192
QUERY_ROWS = 16_384


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def quantised(df: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component x as double; only rows that take part."""
    good = df.where(F.col("vec_id").isNotNull() & usable(F.col(vector)))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Shard:
    """Posting lists of one shard: a row for each dimension, and each dimension's extremes."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
        dims = max((len(v) for v in vectors), default=0)
        x = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
        rows = np.lexsort([*x.T[::-1], ids]) if dims else np.argsort(ids)
        self.ids, x = ids[rows], x[rows]
        self.most = max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0)))))
        # doubles hold sums exactly below 2 ** 53; beyond, Python's integers do
        self.x = np.ascontiguousarray(x.T).astype(np.float64 if self.most < 1 << 53 else object)
        self.high = self.x.max(axis=1) if len(self.ids) and dims else np.zeros(dims)
        self.low = self.x.min(axis=1) if len(self.ids) and dims else np.zeros(dims)

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The best k (vec_id, score) of the shard: higher score first, then smaller vec_id."""
        if not len(self.ids):
            return []
        dims = self.x.shape[0]
        q = np.zeros(dims, object)
        q[: min(dims, len(query))] = [int(c) for c in query[:dims]]
        exact = dims * self.most * max((abs(int(c)) for c in query), default=0) < 1 << 53
        q = q.astype(np.float64) if exact else q
        x = self.x if exact else self.x.astype(object)
        bound = np.maximum(np.maximum(q * self.high, q * self.low), 0)
        order = np.argsort(-bound.astype(np.float64), kind="stable")  # strongest term first
        order = order[q[order] != 0]
        others = self.ids != own
        if not len(order):
            rows = np.flatnonzero(others)[:k]
            return [(int(self.ids[r]), 0) for r in rows]
        # a first threshold: full scores of the vectors with the largest gain in the strongest terms
        lead = x[order[:8]].T @ q[order[:8]]
        lead = np.where(others, lead, -np.inf if exact else -(10**40))
        n = min(len(lead), 4 * k)
        seed = np.argpartition(-lead.astype(np.float64), n - 1)[:n] if n < len(lead) else np.arange(len(lead))
        seed = seed[others[seed]]
        full = q @ x[:, seed]
        threshold = np.sort(full)[-k] if len(full) >= k else None
        # terms behind the split are non-essential: together they stay below the threshold
        rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
        split = len(order) if threshold is None else int(np.argmax(rest < threshold)) if (rest < threshold).any() else len(order)
        essential = order[:split]
        if threshold is None or threshold <= 0 and split == len(order):
            rows = np.flatnonzero(others)
        else:
            met = np.zeros(len(self.ids), bool)
            for d in essential:
                met |= x[d] > 0 if q[d] > 0 else x[d] < 0
                if met.all():
                    break
            rows = np.flatnonzero(met & others)
        score = q[essential] @ (x[essential] if len(rows) == len(self.ids) else x[np.ix_(essential, rows)]) if split else np.zeros(len(rows), x.dtype)
        for at in range(split, len(order), 4):
            if threshold is not None:
                live = score + rest[at] >= threshold
                rows, score = rows[live], score[live]
            group = order[at : at + 4]
            score = score + q[group] @ x[np.ix_(group, rows)]
        if threshold is not None:
            live = score >= threshold
            rows, score = rows[live], score[live]
        best = np.lexsort([self.ids[rows], -score.astype(np.float64)])[:k] if exact else sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k]
        return [(int(self.ids[rows[i]]), int(score[i])) for i in best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors (vec_id, v) of each query (vec_id, v) but rows of its own id."""
    n_shards = max(1, math.ceil(vectors.count() / SHARD_ROWS))
    n_blocks = max(1, math.ceil(queries.count() / QUERY_ROWS))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int")
    docs = vectors.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "vec_id", "v")
    asks = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), block.alias("block"), "vec_id", "v")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = Shard(left["vec_id"].to_numpy(np.int64), list(left["v"]))
        out = [(q, d, s) for q, v in zip(right["vec_id"], right["v"], strict=True) for d, s in own.top(q, v, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    found = docs.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
