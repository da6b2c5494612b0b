"""Clustered inference and budgeted samples against plain loops with the same draws."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from statistics import NormalDist, stdev

import pytest
from pyspark.sql import functions as F

from tapewright.functions import probability
from tapewright.operators import inference


def plain_auc(rows):
    """rows: (score, positive, weight)."""
    pos, neg = [r for r in rows if r[1] and r[2]], [r for r in rows if not r[1] and r[2]]
    pairs = sum(p[2] * n[2] for p in pos for n in neg)
    return sum(p[2] * n[2] * (1.0 if p[0] > n[0] else 0.5 if p[0] == n[0] else 0.0) for p in pos for n in neg) / pairs if pairs else None


def test_cluster_auc_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [("f", round(rng.gauss(0.4 * (i % 3 == 0), 1), 1), i % 3 == 0, i % 7) for i in range(260)] + [("f", -9.0, True, 7), ("f", 9.0, False, 8)]
    odd = [("few", 1.0, True, 1), ("few", 2.0, False, 1), (None, 1.0, True, 1), ("f", None, True, 1), ("f", float("nan"), True, 1), ("f", 1.0, None, 1), ("f", 1.0, True, None)]
    flat = [("flat", 3.0, i % 2 == 0, i % 4) for i in range(80)]
    df = spark.createDataFrame(rows + odd + flat, "feature string, score double, hit boolean, week int").repartition(3)
    got = {r["feature"]: r for r in inference.cluster_auc(df, "feature", "score", F.col("hit"), "week", 3, 60, ranges=8).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"f": "quantified", "few": "insufficient", "flat": "constant"}
    assert got["flat"]["auc"] is None and (got["few"]["n_positive"], got["few"]["n_negative"]) == (1, 1)
    n, f = 9, got["f"]
    whole = plain_auc([(s, p, 1) for _, s, p, _ in rows])
    drawn, extreme = [], 0
    for b in range(60):
        weight = defaultdict(int)
        for i in range(n):
            weight[inference.number(3, b, i) % n] += 1
        drawn.append(plain_auc([(s, p, weight[c]) for _, s, p, c in rows]))
        other = plain_auc([(s, p != (inference.number(4, b, c) % 2 == 1), 1) for _, s, p, c in rows])
        extreme += abs(other - 0.5) >= abs(whole - 0.5) - 1e-12
    drawn.sort()
    assert (f["auc"], f["low"], f["high"], f["p"]) == pytest.approx((whole, drawn[int(0.025 * 59)], drawn[int(0.975 * 59)], (extreme + 1) / 61))
    assert f["early_auc"] == pytest.approx(plain_auc([(s, p, 1) for _, s, p, c in rows if c < 6])) and f["latest_auc"] == pytest.approx(plain_auc([(s, p, 1) for _, s, p, c in rows if c >= 6]))
    assert inference.cluster_auc(df.limit(0), "feature", "score", F.col("hit"), "week").count() == 0


def test_improvements_equal_a_loop(spark):
    rng = random.Random(4)
    rows = [("m", f"e{i % 25:02d}", rng.gauss(0.1, 1)) for i in range(200)] + [("small", f"e{i}", float(i)) for i in range(3)] + [("alike", f"e{i}", 0.5) for i in range(22)] + [("one", "e", 1.0)]
    df = spark.createDataFrame(rows, "model string, episode string, gain double").repartition(3)
    got = {r["model"]: r for r in inference.improvements(df, "model", "episode", ["gain"], 5, 80).collect()}
    by = defaultdict(list)
    for m, e, g in rows:
        if m == "m":
            by[e].append(g)
    means = [sum(v) / len(v) for _, v in sorted(by.items())]
    mean = sum(means) / 25
    drawn = sorted(sum(means[inference.number(5, b, i) % 25] for i in range(25)) / 25 for b in range(80))
    assert (got["m"]["mean_gain"], got["m"]["low_gain"], got["m"]["high_gain"]) == pytest.approx((mean, drawn[int(0.025 * 79)], drawn[int(0.975 * 79)]))
    assert got["m"]["p_gain"] == pytest.approx(1 - NormalDist().cdf(mean / (stdev(means) / 5)), abs=1e-12)
    assert got["small"]["low_gain"] is None and got["small"]["p_gain"] is not None and got["alike"]["p_gain"] == 0.0 and got["one"]["p_gain"] is None


def test_normal_cdf(spark):
    xs = [-12.0, -8.5, -3.0, -1.0, -0.1, 0.0, 0.1, 0.5, 1.0, 2.5, 5.0, 8.5, 12.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", probability.normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r["p"] - NormalDist().cdf(r["x"])) < 1e-13 for r in got)


@pytest.mark.parametrize("budget", [0, 1, 7, 8, 50, 51, 199, 200, 5000])
def test_admitted_groups_equal_the_loop(spark, budget):
    rng = random.Random(9)
    groups = [(f"g{i}", rng.choice([1, 1, 2, 3, 8, 40])) for i in range(40)]
    order = sorted(groups, key=lambda g: (hashlib.md5(f"3/{g[0]}".encode()).hexdigest(), g[0]))
    total, want = 0, []
    for g, n in order:
        if want and total + n > budget:
            continue
        want.append(g)
        total += n
        if total >= budget:
            break
    df = spark.createDataFrame(groups, "g string, n int").repartition(3)
    for chunk in (5, 1000):
        assert sorted(r["g"] for r in inference.admitted_groups(df, "g", "n", budget, 3, chunk).collect()) == sorted(want)
