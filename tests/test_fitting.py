"""Distributed fits against plain loops, and the storage of intermediate tables."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright import storage
from tapewright.functions import probability
from tapewright.operators import fitting

CLASSES = fitting.CLASSES
NAMES = ["f", "g", "rule::h"]


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(11)
    out = []
    for i in range(240):
        p = rng.dirichlet([2, 2, 3])
        f, g, h = (float(x) for x in rng.normal(size=3))
        weights = p * np.exp([0.8 * f, -0.5 * g, 0])
        label = CLASSES[int(rng.choice(3, p=weights / weights.sum()))]
        out.append((label, *(float(x) for x in p), f, 3 + 2 * g, h / 100, ("4h", "24h")[i % 2], *(float(x) for x in rng.uniform(0.02, 0.1, 2)), float(rng.uniform(0.02, 0.08))))
    return out


SCHEMA = "label string, p_tp double, p_sl double, p_expiry double, f double, g double, `rule::h` double, horizon string, up double, down double, sigma double"
ODD = [("ambiguous", 0.3, 0.3, 0.4, 0.0, 0.0, 0.0, "4h", 0.1, 0.1, 0.1), (None, 0.3, 0.3, 0.4, 0.0, 0.0, 0.0, "4h", 0.1, 0.1, 0.1), ("expiry", None, 0.3, 0.4, 0.0, 0.0, 0.0, "4h", 0.1, 0.1, 0.1), ("expiry", 0.3, 0.3, 0.4, float("nan"), 0.0, 0.0, "4h", 0.1, 0.1, None)]


def standard(rows, at):
    values = [[r[k] for r in rows] for k in at]
    means = [math.fsum(v) / len(v) for v in values]
    scales = [max(math.sqrt(math.fsum((x - m) ** 2 for x in v) / len(v)), 1e-12) for v, m in zip(values, means, strict=True)]
    return [[1.0, *((r[k] - m) / s for k, m, s in zip(at, means, scales, strict=True))] for r in rows]


def adam_by_hand(rows, loss_gradient, width, ridge, steps, rate):
    """Plain loops: loss_gradient(row, coefficients) gives the loss and its derivatives by the two causes' offsets."""
    c, m, v, losses = ([[0.0] * width for _ in range(2)] for _ in range(3)), None, None, []
    c, m, v = c
    for step in range(1, steps + 1):
        grads, total = [[0.0] * width for _ in range(2)], 0.0
        for x, row in rows:
            loss, by = loss_gradient(row, [math.fsum(b * k for b, k in zip(c[j], x, strict=True)) for j in range(2)])
            total += loss
            for j in range(2):
                for k in range(width):
                    grads[j][k] += by[j] * x[k] / len(rows)
        losses.append(total / len(rows) + sum(ridge * b * b / 2 / len(rows) for j in range(2) for b in c[j][1:]))
        for j in range(2):
            for k in range(width):
                g = max(-10.0, min(10.0, grads[j][k] + (ridge * c[j][k] / len(rows) if k else 0.0)))
                m[j][k], v[j][k] = 0.9 * m[j][k] + 0.1 * g, 0.999 * v[j][k] + 0.001 * g * g
                c[j][k] -= rate * (m[j][k] / (1 - 0.9**step)) / (math.sqrt(v[j][k] / (1 - 0.999**step)) + 1e-8)
    return c, losses


def softmax_by_hand(row, eta):
    w = [max(row[1], 1e-15) * math.exp(eta[0]), max(row[2], 1e-15) * math.exp(eta[1]), max(row[3], 1e-15)]
    p = [x / sum(w) for x in w]
    own = CLASSES.index(row[0])
    return -math.log(p[own]), [p[j] - (own == j) for j in range(2)]


def test_softmax_fit_equals_a_loop(spark, cases):
    df = spark.createDataFrame(cases + ODD, SCHEMA).repartition(3)
    fit = fitting.fit_softmax_offset(df, NAMES, (0.5, 20.0), steps=15)
    assert fit.rows == len(cases) and fit.losses.shape == (15, 2)
    rows = list(zip(standard(cases, (4, 5, 6)), cases, strict=True))
    for i, ridge in enumerate(fit.ridges):
        c, losses = adam_by_hand(rows, softmax_by_hand, 4, ridge, 15, fitting.RATE)
        assert np.abs(fit.coefficients[i] - np.array(c)).max() < 1e-9
        assert np.abs(fit.losses[:, i] - np.array(losses)).max() < 1e-9
    assert (np.diff(fit.losses, axis=0) < 0).all()  # the loss falls in every step
    assert fit.table(df).count() == 2 * 2 * 4


def test_ridges_are_judged_by_horizon(spark, cases):
    df = spark.createDataFrame(cases + ODD, SCHEMA).repartition(2)
    fit = fitting.Fit(tuple(NAMES), (0.1, 1.0), np.array([0.1, 3.0, 0.0]), np.array([1.0, 2.0, 0.01]), np.array([[[0.1, 0.5, 0, 0], [0, 0, -0.4, 0.1]], [[0.0] * 4] * 2]), np.zeros((0, 2)), 1)
    got = {r["ridge"]: r for r in fitting.ridge_scores(fit, df, "horizon").collect()}
    for i, ridge in enumerate(fit.ridges):
        means = []
        for h in ("4h", "24h"):
            own = []
            for r in cases:
                if r[7] == h:
                    z = [1.0, *((r[4 + k] - fit.means[k]) / fit.scales[k] for k in range(3))]
                    w = [r[1] * math.exp(z @ fit.coefficients[i][0]), r[2] * math.exp(z @ fit.coefficients[i][1]), r[3]]
                    p = [x / sum(w) for x in w]
                    own.append((-math.log(p[CLASSES.index(r[0])]), sum((x - (r[0] == c)) ** 2 for x, c in zip(p, CLASSES, strict=True))))
            means.append(np.mean(own, axis=0))
        assert (got[ridge]["log_loss"], got[ridge]["brier"], got[ridge]["n"]) == pytest.approx((*np.mean(means, axis=0), len(cases)))
    assert [r for r, x in got.items() if x["selected"]] == [min(got, key=lambda r: got[r]["log_loss"])]


def test_evidence_fit_equals_a_loop(spark, cases):
    cases = cases[:60]
    df = spark.createDataFrame([*cases, *ODD[:2], ODD[3]], SCHEMA).repartition(2)
    fit = fitting.fit_evidence(df, ["f"], (1.0,), steps=4, intervals=6)
    hazards = df.where("sigma is not null and label in ('take_profit', 'stop_loss', 'expiry')").select("f", probability.interval_hazards(F.col("up"), F.col("down"), F.col("sigma"), 6).alias("h"))
    by_f = {r["f"]: [(x["tp"], x["sl"], x["none"]) for x in r["h"]] for r in hazards.collect()}

    def outcome(h, a, b):
        tp = sl = 0.0
        alive = 1.0
        for x, y, z in h:
            w = x * math.exp(a), y * math.exp(b), z
            tp, sl, alive = tp + alive * w[0] / sum(w), sl + alive * w[1] / sum(w), alive * w[2] / sum(w)
        return tp, sl, alive

    def gradient(row, eta):
        own, h, e = CLASSES.index(row[0]), by_f[row[4]], 1e-5
        loss = lambda a, b: -math.log(max(1e-15, outcome(h, a, b)[own]))
        return loss(*eta), [(loss(eta[0] + e, eta[1]) - loss(eta[0] - e, eta[1])) / (2 * e), (loss(eta[0], eta[1] + e) - loss(eta[0], eta[1] - e)) / (2 * e)]

    c, losses = adam_by_hand(list(zip(standard(cases, (4,)), cases, strict=True)), gradient, 2, 1.0, 4, fitting.EVIDENCE_RATE)
    assert np.abs(fit.coefficients[0] - np.array(c)).max() < 1e-6 and np.abs(fit.losses[:, 0] - np.array(losses)).max() < 1e-6
    # moved by no evidence, hazards give the plain curve again
    plain = df.where("sigma > 0").limit(5).select(probability.competing_risks(F.col("up"), F.col("down"), F.col("sigma"), F.lit(0.0), F.lit(0.0), 6).alias("a"), probability.double_barrier(F.col("up"), F.col("down"), F.col("sigma")).alias("b")).collect()
    assert all(r["a"]["p_tp"] == pytest.approx(r["b"]["p_tp"], abs=1e-9) for r in plain)


def test_fit_of_an_empty_table(spark):
    fit = fitting.fit_softmax_offset(spark.createDataFrame([], SCHEMA), NAMES, steps=2)
    assert fit.rows == 0 and not fit.coefficients.any()


def test_stored_tables_are_read_again_and_cleared(spark):
    df = storage.stored(spark.range(10), "ten")
    assert df.count() == 10 and df.dtypes == spark.range(10).dtypes
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and storage.clear(spark) >= 1 and not os.path.exists(path)
