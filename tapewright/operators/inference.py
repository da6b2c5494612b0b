"""Resampling by clusters: rank statistics and mean improvements whose rows are drawn cluster by cluster (a week, an episode).

A weighted AUC is a sum over pairs of groups (a cluster and a label): of how many pairs of rows one group's score is higher, times the clusters' weights. So the
rows are passed once, into a matrix of wins between groups, and every replicate is a product with that small matrix. Wins are counted within ranges of scores,
one task for each, and totals of the ranges give the wins between ranges. A task holds the distinct scores of one range by group, or one feature's
matrix; groups are bounded by the clusters, of which there are as many as weeks.

Draws are taken from digests of seed, draw and number, so they can be repeated anywhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.probability import normal_cdf
from tapewright.storage import stored

#: Ranges of scores of one feature.
RANGES = 64
#: Draws, quantiles, the least numbers of rows, and the share of clusters that are early.
DRAWS, QUANTILES = 400, (0.025, 0.975)
LEAST_ROWS, LEAST_CLASS, EARLY = 50, 10, 0.7
BLOCK = 1024


def number(*parts: object) -> int:
    return int(hashlib.md5("/".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def wins_within(scores: np.ndarray, groups: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Matrix of how many pairs of rows of two groups the first one's score is higher in, ties half; rows are (score, group, count)."""
    order = np.argsort(scores, kind="stable")
    scores, groups, counts = scores[order], groups[order], counts[order]
    _, place = np.unique(scores, return_inverse=True)
    out, below = np.zeros((size, size)), np.zeros(size)
    for at in range(0, place[-1] + 1 if len(place) else 0, BLOCK):
        a, b = np.searchsorted(place, [at, at + BLOCK])
        m = np.zeros((min(BLOCK, int(place[-1]) + 1 - at), size))
        np.add.at(m, (place[a:b] - at, groups[a:b]), counts[a:b])
        upto = np.cumsum(m, axis=0)
        out += m.T @ (below + upto - m / 2)
        below = below + upto[-1]
    return out


def replicates(wins: np.ndarray, sizes: np.ndarray, seed: int, draws: int) -> dict[str, float | None]:
    """auc, its interval from clusters drawn with replacement, p from labels swapped by cluster, and the AUC of early and later clusters.

    wins[x, c, y, d]: pairs of a row of label x in cluster c and one of label y in cluster d that the first wins; sizes[x, c]: rows.
    """
    n = sizes.shape[1]

    def auc(positive: np.ndarray, negative: np.ndarray) -> float | None:
        """Of weights of the positive rows (label, cluster) and of the negative ones."""
        pairs = (positive * sizes).sum() * (negative * sizes).sum()
        return float(np.einsum("xc,xcyd,yd->", positive, wins, negative) / pairs) if pairs else None

    def of(weights: np.ndarray) -> float | None:
        zero = np.zeros(n)
        return auc(np.stack([zero, weights]), np.stack([weights, zero]))

    whole = of(np.ones(n))
    if whole is None:
        return {}
    drawn = [of(np.bincount([number(seed, b, i) % n for i in range(n)], minlength=n).astype(float)) for b in range(draws)]
    drawn = sorted(x for x in drawn if x is not None)
    extreme = 0
    for b in range(draws):
        swap = np.array([number(seed + 1, b, c) % 2 for c in range(n)], float)
        other = auc(np.stack([swap, 1 - swap]), np.stack([1 - swap, swap]))
        extreme += other is not None and abs(other - 0.5) >= abs(whole - 0.5) - 1e-12
    early = np.arange(n) < max(1, int(n * EARLY))
    enough = len(drawn) >= 0.8 * draws
    low, high = (drawn[int(q * (len(drawn) - 1))] if enough else None for q in QUANTILES)
    return {"auc": whole, "low": low, "high": high, "p": (extreme + 1) / (draws + 1), "early_auc": of(early.astype(float)), "latest_auc": of((~early).astype(float))}


def cluster_auc(rows: DataFrame, feature: str, score: str, positive: Column, cluster: str, seed: int = 7, draws: int = DRAWS, ranges: int = RANGES) -> DataFrame:
    """feature, n_positive, n_negative, status, auc, low, high, early_auc, latest_auc, p of each feature of rows (a row for each case and feature).

    status is insufficient (few rows of either label), constant (one score only) or quantified. Rows with a null feature, score, label or cluster take no part.
    """
    good = rows.select(F.col(feature).alias("feature"), F.col(score).cast("double").alias("score"), positive.alias("positive"), F.col(cluster).alias("cluster"))
    good = good.where(F.col("feature").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("positive").isNotNull() & F.col("cluster").isNotNull())
    counted = stored(good.groupBy("feature", "score", "positive", "cluster").agg(F.count("*").alias("n")), "auc-counts")
    # clusters of all features, numbered in order: a row for each
    clusters = stored(counted.select("cluster").distinct().withColumn("c", F.row_number().over(Window.orderBy("cluster")) - 1), "auc-clusters")
    n_clusters = clusters.count()
    cuts = counted.groupBy("feature").agg(F.percentile_approx("score", [i / ranges for i in range(1, ranges)], 10_000).alias("cuts"))
    placed = counted.join(F.broadcast(clusters), "cluster").join(F.broadcast(cuts), "feature")
    placed = placed.select("feature", F.size(F.filter("cuts", lambda x: x < F.col("score"))).alias("range"), "score", (F.col("positive").cast("int") * n_clusters + F.col("c")).cast("int").alias("g"), "n")
    size = 2 * n_clusters

    def within(df: pd.DataFrame) -> pd.DataFrame:
        wins = wins_within(df["score"].to_numpy(), df["g"].to_numpy(), df["n"].to_numpy(np.float64), size)
        totals = np.bincount(df["g"], weights=df["n"], minlength=size)
        return pd.DataFrame({"feature": [df["feature"].iloc[0]], "range": [df["range"].iloc[0]], "wins": [wins.ravel()], "totals": [totals], "scores": [df["score"].nunique()]})

    parts = placed.groupBy("feature", "range").applyInPandas(within, "feature string, range int, wins array<double>, totals array<double>, scores long")

    def combined(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("range")
        totals = np.stack(df["totals"])
        wins = np.sum([w.reshape(size, size) for w in df["wins"]], axis=0) + totals.T @ (np.cumsum(totals, axis=0) - totals)
        sizes = totals.sum(axis=0).reshape(2, n_clusters)
        negatives, positives = (int(x) for x in sizes.sum(axis=1))
        few = positives + negatives < LEAST_ROWS or min(positives, negatives) < LEAST_CLASS
        status = "insufficient" if few else "constant" if df["scores"].sum() < 2 else "quantified"
        found = replicates(wins.reshape(2, n_clusters, 2, n_clusters), sizes, seed, draws) if status == "quantified" else {}
        names = ("auc", "low", "high", "early_auc", "latest_auc", "p")
        return pd.DataFrame({"feature": [df["feature"].iloc[0]], "n_positive": [positives], "n_negative": [negatives], "status": [status], **{k: pd.Series([found.get(k)], dtype="float64") for k in names}})

    out = parts.groupBy("feature").applyInPandas(combined, "feature string, n_positive long, n_negative long, status string, auc double, low double, high double, early_auc double, latest_auc double, p double")
    return out.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def improvements(rows: DataFrame, key: str, cluster: str, values: list[str], seed: int = 7, draws: int = DRAWS, least: int = 20) -> DataFrame:
    """key, clusters, and of each value: mean over clusters of their means, its interval from drawn clusters (null for fewer than least), and p of a mean above 0.

    p is one-sided and normal; of clusters that are all alike it is 0 for a mean above 0, else 1.
    """
    by_cluster = rows.groupBy(F.col(key).alias("key"), F.col(cluster).alias("cluster")).agg(*[F.avg(v).alias(v) for v in values])
    by_cluster = stored(by_cluster, "improvement-clusters")
    stats = [x for v in values for x in (F.avg(v).alias(f"mean_{v}"), F.stddev_samp(v).alias(f"dev_{v}"))]
    out = by_cluster.groupBy("key").agg(F.count("*").alias("clusters"), *stats)
    for v in values:
        error = F.col(f"dev_{v}") / F.sqrt("clusters")
        alike = F.when(F.col(f"mean_{v}") > 0, 0.0).otherwise(1.0)
        out = out.withColumn(f"p_{v}", F.when(F.col("clusters") < 2, F.lit(None)).when(error <= 1e-15, alike).otherwise(1 - normal_cdf(F.col(f"mean_{v}") / error)))
    # a task holds one key's cluster means in order of their names
    schema = "key string, " + ", ".join(f"low_{v} double, high_{v} double" for v in values)

    def drawn(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("cluster")
        n, found = len(df), {"key": [df["key"].iloc[0]]}
        picks = np.array([[number(seed, b, i) % n for i in range(n)] for b in range(draws)]) if n >= least else None
        for v in values:
            means = np.sort(df[v].to_numpy()[picks].mean(axis=1)) if picks is not None else None
            for side, q in zip(("low", "high"), QUANTILES, strict=True):
                found[f"{side}_{v}"] = pd.Series([None if means is None else float(means[int(q * (draws - 1))])], dtype="float64")
        return pd.DataFrame(found)

    ranges = by_cluster.groupBy("key").applyInPandas(drawn, schema)
    ranges = ranges.select("key", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ranges.columns[1:]])
    return out.join(ranges, "key").select(F.col("key").alias(key), "clusters", *[f"{s}_{v}" for v in values for s in ("mean", "low", "high", "p")])


def admitted_groups(groups: DataFrame, group: str, rows: str, budget: int, seed: int, chunk: int = 4096) -> DataFrame:
    """The groups that a plain loop over all groups in the order of their digests admits: each that still fits under a budget of rows, and always the first.

    The loop's whole state is the sum so far. Groups are sorted by digest over partitions; each partition is passed with the sum that the ones before
    leave, and only sums reach the driver. A group larger than what is left is skipped, and later ones may still fit. Once the budget is full, the
    partitions left are not passed at all. groups has a row for each group.
    """
    spark = groups.sparkSession
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(group).cast("string")).cast("binary"))
    n = max(1, -(-groups.count() // chunk))
    asked = groups.select(F.col(group).alias("g"), F.col(rows).cast("long").alias("n"), digest.alias("d")).repartitionByRange(n, "d", "g").sortWithinPartitions("d", "g")
    ordered = stored(asked.withColumn("part", F.spark_partition_id()), "sample-groups")
    # what a partition could add at most, and its smallest group: enough to pass over those into which nothing fits
    parts = ordered.groupBy("part").agg(F.min("n").alias("least"), F.sum("n").alias("most")).orderBy("part").toLocalIterator()
    total, whole, opened = 0, [], []
    for p in parts:
        if total and total + p["least"] > budget:
            continue
        if total + p["most"] <= budget:
            whole.append(p["part"])
            total += p["most"]
            continue
        left = [(r["d"], r["g"], r["n"]) for r in ordered.where(F.col("part") == p["part"]).collect()]  # about chunk groups
        for d, g, size in sorted(left, key=lambda r: (r[0], r[1])):
            if total and total + size > budget:
                continue
            opened.append((p["part"], d))
            total += size
        if total >= budget:
            break
    taken = ordered.where(F.col("part").isin(whole)) if whole else ordered.limit(0)
    if opened:
        marks = spark.createDataFrame(opened, "part int, d string")
        taken = taken.unionByName(ordered.join(F.broadcast(marks), ["part", "d"], "left_semi"))
    return taken.select(F.col("g").alias(group), F.col("n").alias(rows))


__all__ = ["admitted_groups", "cluster_auc", "improvements", "number", "replicates", "wins_within"]
