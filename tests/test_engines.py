"""Analogs by boxes against brute force, stage contexts, and the chained engines' invariants."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapewright.operators import analogs, engines, stages

PENALTY = 0.15


def brute_nearest(rows, queries, k, size):
    out = {}
    for qid, qs, qt, qv in queries:
        if qv is None or any(x is None or not math.isfinite(x) for x in qv):
            continue
        near = []
        for rid, s, t, v in rows:
            if t < qt and v is not None and all(x is not None and math.isfinite(x) for x in v):
                total = 0.0  # added one by one: sum() would round once only
                for a, b in zip(qv, v, strict=True):
                    total += min(36.0, (a - b) * (a - b))
                near.append((math.sqrt(total / size) + (0.0 if s == qs else PENALTY), rid))
        for rank, (d, rid) in enumerate(sorted(near)[:k], 1):
            out[qid, rank] = (rid, d)
    return out


@pytest.mark.parametrize(("size", "cell_rows"), [(3, 4), (2, 256)])
def test_nearest_rows_equal_brute_force(spark, size, cell_rows):
    rng = random.Random(size)
    rows = [(f"r{i:04d}", rng.choice(["a", "b", "hot", "hot"]), rng.randrange(50), [round(rng.gauss(0, 1), 1) for _ in range(size)]) for i in range(900)]
    rows += [("same1", "a", 3, rows[0][3]), ("same2", "a", 3, rows[0][3]), ("far", "b", 1, [50.0] * size), ("null", "a", 1, None), ("hole", "a", 1, [None] + [0.0] * (size - 1)), ("nan", "a", 1, [float("nan")] * size)]
    queries = [(f"q{r[0]}", r[1], r[2], r[3]) for r in rows[::9]] + [("early", "a", 0, [0.0] * size), ("new", "zz", 99, [0.3] * size), ("bad", "a", 9, None)]
    df = spark.createDataFrame(rows, "row_id string, symbol string, at_ms long, v array<double>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id string, symbol string, at_ms long, v array<double>").repartition(2)
    tree = analogs.Boxes(df, size, cell_rows)
    assert len(tree.levels) == (2 if cell_rows == 4 else 1)
    got = {(r["query_id"], r["rank"]): (r["row_id"], r["dist"]) for r in tree.nearest(asked, 4, PENALTY).collect()}
    want = brute_nearest(rows, queries, 4, size)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert analogs.Boxes(df.limit(0), size).nearest(asked, 4).count() == 0 and tree.nearest(asked.limit(0), 4).count() == 0


def test_few_pairs_are_compared(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i:05d}", "ab"[i % 2], i, [float(x) for x in rng.normal(size=3)]) for i in range(6000)]
    df = spark.createDataFrame(rows, "row_id string, symbol string, at_ms long, v array<double>")
    asked = df.where("at_ms % 24 = 0").withColumnRenamed("row_id", "query_id")
    pairs = analogs.Boxes(df, 3, 64).pairs(asked, 5, PENALTY).count()
    assert pairs < 0.25 * (6000 * 6000 / 24 / 2)  # of all earlier rows of every query


def test_merged_scales_equal_frames(spark):
    rng = random.Random(1)
    bars, price = [], 100.0
    for i in range(120):
        o, price = price, price * math.exp(rng.gauss(0, 0.01))
        bars.append(("s", i * 10, o, max(o, price) * 1.001, min(o, price) * 0.999, price, 1.0 + rng.random()))
    df = spark.createDataFrame(bars, "symbol string, open_ms long, open double, high double, low double, close double, volume double")
    got = {r["open_ms"]: r for r in stages.contexts(df, {"x": 2, "y": 6, "z": 24}).collect()}
    assert sorted(got) == [i * 10 for i in range(24, 120)]
    rets = [0.0] + [math.log(bars[i][5] / bars[i - 1][5]) for i in range(1, 120)]
    for t, r in got.items():
        i = t // 10
        for name, size in (("x", 2), ("y", 6), ("z", 24)):
            own, span = rets[i - size + 1 : i + 1], bars[i - size + 1 : i + 1]
            high, low = max(b[3] for b in span), min(b[4] for b in span)
            assert r[f"sigma_{name}"] == pytest.approx(math.sqrt(sum(x * x for x in own))) and (r[f"high_{name}"], r[f"low_{name}"]) == (high, low)
            assert r[f"efficiency_{name}"] == pytest.approx(sum(own) / sum(map(abs, own))) and r[f"place_{name}"] == pytest.approx((bars[i][5] - low) / (high - low))
            assert r[f"activity_{name}"] == pytest.approx(math.log(sum(b[6] for b in span) / size / (sum(b[6] for b in bars[i - 23 : i + 1]) / 24)))
    plan = stages.contexts(df, {"x": 2, "y": 6, "z": 24})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    with pytest.raises(ValueError):
        stages.contexts(df, {"x": 4, "y": 6})


SEQ = "plan_id string, up double, down double, sigma_4h double, sigma_24h double, sigma_7d double, f double"
MODELS = {"4h": {"tp": {"intercept": (0.2, 0.0, 1.0), "f": (0.5, 1.0, 2.0)}, "sl": {}}, "7d": {"tp": {}, "sl": {"f": (1.0, 0.0, 1.0)}}}


def test_sequential_stages_are_chained(spark):
    rows = [("a", 0.05, 0.04, 0.03, 0.06, 0.2, 1.5), ("b", 0.05, 0.04, 0.03, 0.06, 0.9, 1.5), ("c", 0.001, 0.001, 0.5, 0.5, 0.5, 0.0), ("d", 0.5, 0.5, 0.001, 0.002, 0.01, -3.0)]
    got = {r["plan_id"]: r for r in stages.sequential(spark.createDataFrame(rows, SEQ), MODELS).collect()}
    for r in got.values():
        before = (0.0, 0.0, 1.0)
        for n in stages.SCALES:
            p = tuple(r[f"{c}_{n}"] for c in ("tp", "sl", "none"))
            assert abs(sum(p) - 1) < 1e-12 and min(p) >= -1e-12
            assert p[0] >= before[0] - 1e-12 and p[1] >= before[1] - 1e-12 and p[2] <= before[2] + 1e-12
            before = p
    # a later stage's context and model change nothing before
    assert all(got["a"][f"{c}_{n}"] == got["b"][f"{c}_{n}"] for c in ("tp", "sl", "none") for n in ("4h", "24h")) and got["a"]["tp_7d"] != got["b"]["tp_7d"]
    plain = {r["plan_id"]: r for r in stages.sequential(spark.createDataFrame(rows, SEQ), {}).collect()}
    from tapewright.functions import probability

    whole = spark.createDataFrame(rows, SEQ).withColumn("p", probability.double_barrier(F.col("up"), F.col("down"), F.sqrt(F.col("sigma_4h") ** 2 + F.col("sigma_24h") ** 2 * (20 / 24) + F.col("sigma_7d") ** 2 * (144 / 168))))
    for r in whole.collect():  # without models the chain gives the plain curve
        assert plain[r["plan_id"]]["tp_7d"] == pytest.approx(r["p"]["p_tp"], abs=1e-9)


def test_stage_labels(spark):
    cases = [(3, None, "tp"), (None, 5, "sl"), (6, 6, "ambiguous"), (2, 5, None), (5, 2, None), (None, None, "none"), (9, None, "none"), (9, 8, "sl"), (9, 9, "none"), (4, 3, "sl"), (2, 2, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tp int, sl int, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", engines.stage_label(F.col("tp"), F.col("sl"), 2, 8).alias("got")).collect())


def test_empirical_engine_on_a_fixture(spark):
    # eight analogs with like paths: up 0.5 % after 12 hours, 4 % after 120; down 3 % after 10
    up, down = [(0.005, 12), (0.04, 120)], [(0.03, 10)]
    rows = [(f"a{i}/{o}", "x" if i < 5 else "y", i, [0.0 if o == 0 else 5.0] * 2) for i in range(8) for o in (0, 1)]
    paths = spark.createDataFrame([(r[0], *((up, down) if r[0].endswith("0") else (down, up))) for r in rows], "row_id string, favourable array<struct<level:double,step:int>>, adverse array<struct<level:double,step:int>>")
    df = spark.createDataFrame(rows, "row_id string, symbol string, at_ms long, v array<double>")
    tree = analogs.Boxes(df, 2)
    asked = spark.createDataFrame([("q", "x", 100, 0.01, 0.02, [0.0, 0.0], [0.0, 0.0]), ("first", "x", 0, 0.01, 0.02, [0.0, 0.0], [0.0, 0.0])], "query_id string, symbol string, at_ms long, up double, down double, v_day array<double>, v_week array<double>")
    out = engines.empirical(asked, {"day": tree, "week": tree}, paths, {"day": (0, 24), "week": (24, 168)}, PENALTY)
    got = {r["query_id"]: r for r in out.collect()}
    q = got["q"]
    # long: the stop (2 %) is met at hour 10, the target (1 %) at 120: decided in the first stage; short: target 3 % at 10, stop at 120
    near = sorted([(0.0 if i < 5 else PENALTY, "sl") for i in range(8)] + [(5.0 + (0.0 if i < 5 else PENALTY), "tp") for i in range(8)])
    width = max(0.25, near[-1][0])
    weights = {c: sum(math.exp(-0.5 * (d / width) ** 2) for d, x in near if x == c) + 0.5 for c in ("tp", "sl", "none")}
    assert q["n_day"] == 16 and q["alpha_day"] == pytest.approx([weights["tp"], weights["sl"], weights["none"]])
    total = sum(weights.values())
    assert (q["tp_day"], q["sl_day"]) == pytest.approx((weights["tp"] / total, weights["sl"] / total))
    # all analogs are decided before the second stage: its prior alone counts, on what survives
    assert q["n_week"] == 0 and q["tp_week"] == pytest.approx(q["tp_day"] + q["none_day"] / 3)
    assert got["first"]["n_day"] == 0 and got["first"]["tp_day"] == pytest.approx(1 / 3)
    assert all(abs(r["tp_week"] + r["sl_week"] + r["none_week"] - 1) < 1e-12 for r in got.values())
    ranges = {r["query_id"]: r for r in engines.empirical_ranges(out, ["day", "week"]).collect()}
    assert all(ranges["q"][f"{c}_low"] < q[f"{c}_week"] < ranges["q"][f"{c}_high"] for c in ("tp", "sl", "none"))


def test_draws_follow_their_posterior():
    alphas = np.array([[3.0, 2.0, 5.0], [1.0, 4.0, 0.5]])
    drawn = engines.cumulative_draws("plan", alphas, 200_000)
    first, second = alphas[0] / alphas[0].sum(), alphas[1] / alphas[1].sum()
    want = [first[0] + first[2] * second[0], first[1] + first[2] * second[1], first[2] * second[2]]
    assert np.abs(drawn.sum(axis=1) - 1).max() < 1e-12 and np.abs(drawn.mean(axis=0) - want).max() < 3e-3
    assert (engines.cumulative_draws("plan", alphas) == engines.cumulative_draws("plan", alphas)).all()
    assert (engines.cumulative_draws("other", alphas) != engines.cumulative_draws("plan", alphas)).any()


def test_finite_differences_agree_with_the_series(spark):
    from tapewright.functions import probability

    rows = [(f"{u}/{d}/{s}", u, d, s) for u in (0.02, 0.1, 0.4) for d in (0.02, 0.1, 0.4) for s in (0.03, 0.1, 0.5)]
    odd = [("null", None, 0.1, 0.1), ("zero", 0.0, 0.1, 0.1), ("nan", 0.1, 0.1, float("nan"))]
    df = spark.createDataFrame(rows + odd, "k string, up double, down double, sigma double").repartition(2)
    series = {r["k"]: r["p"] for r in df.select("k", probability.double_barrier(F.col("up"), F.col("down"), F.col("sigma")).alias("p")).collect()}
    for r in engines.solved_by_differences(df, "k").collect():
        if r["k"] in ("null", "zero", "nan"):
            assert r["p_tp"] is None
        else:
            assert max(abs(r[c] - series[r["k"]][c]) for c in ("p_tp", "p_sl", "p_expiry")) < 1e-3
            if min(float(x) for x in r["k"].split("/")[:2]) > 0.02:
                assert max(abs(r[c] - series[r["k"]][c]) for c in ("p_tp", "p_sl", "p_expiry")) < 3e-4, r["k"]


def test_overlay_of_rules(spark):
    from tapewright.plans import overlay

    measures = ("efficiency", "volatility_rank", "imbalance", "interest", "displacement", "basis", "premium", "funding")
    rows = [("long", "intraday_wide", 0.4, 0.9, -0.3, 0.01, 0.02, 0.001, -0.002, 0.0003, "evaluated"), ("short", "short_swing", 0.4, 0.9, -0.3, -0.01, -0.02, 0.001, -0.002, 0.0003, "blocked"), ("short", "other", *[0.1] * 8, "evaluated")]
    df = spark.createDataFrame(rows, "side string, horizon string, " + ", ".join(f"{m} double" for m in measures) + ", funding_status string")
    found = overlay.signals(F.col("side") == "long", {m: F.col(m) for m in measures})
    statuses = {n: F.col("funding_status") if n == "funding" else F.lit("evaluated") for n in overlay.WEIGHTS}
    p = F.struct(F.lit(0.3).alias("tp"), F.lit(0.5).alias("sl"), F.lit(0.2).alias("none"))
    df = df.withColumn("rules", overlay.active_rules(F.col("horizon"), statuses, found)).withColumn("p", p).withColumn("after", overlay.folded(F.col("p"), F.col("rules")))
    got = df.withColumn("parts", overlay.contributions(F.col("p"), F.col("rules"), F.col("after"))).collect()

    def by_hand(r, without=None):
        d = 1.0 if r["side"] == "long" else -1.0
        clip = lambda x: max(-1.0, min(1.0, x))
        sign = lambda x: (x > 0) - (x < 0)
        s = {"path_structure": clip(d * r["efficiency"]), "regime": clip(d * r["efficiency"] * (2 * r["volatility_rank"] - 1)), "imbalance": clip(d * r["imbalance"]), "interest": math.tanh(50 * abs(r["interest"])), "price_interest": clip(d * sign(r["displacement"]) * math.tanh(50 * r["interest"])), "basis": -d * math.tanh(100 * r["basis"]), "premium": -d * math.tanh(200 * r["premium"]), "funding": -d * math.tanh(r["funding"] / 0.0005)}
        tp, sl, none = 0.3, 0.5, 0.2
        for rule, weight in overlay.WEIGHTS.items():
            if rule == without or rule == "funding" and r["funding_status"] != "evaluated":
                continue
            e, resolved = weight * overlay.SHARES[r["horizon"]][rule] * s[rule], tp + sl
            if rule == "interest":
                after = resolved * math.exp(e) / (resolved * math.exp(e) + none * math.exp(-e))
                tp, sl, none = after * tp / resolved, after * sl / resolved, 1 - after
            else:
                share = tp * math.exp(e) / (tp * math.exp(e) + sl * math.exp(-e))
                tp, sl = resolved * share, resolved * (1 - share)
        return tp, sl, none

    assert got[2]["after"] is None and got[2]["rules"] is None
    for r in got[:2]:
        after = by_hand(r)
        assert tuple(r["after"]) == pytest.approx(after) and abs(sum(r["after"]) - 1) < 1e-12
        assert [x["rule"] for x in r["parts"]] == [n for n in overlay.WEIGHTS if n != "funding" or r["funding_status"] == "evaluated"]
        for part in r["parts"]:
            assert (part["tp"], part["sl"], part["none"]) == pytest.approx(tuple(a - b for a, b in zip(after, by_hand(r, part["rule"]), strict=True)), abs=1e-12)


def test_ablations_equal_a_loop(spark):
    from tapewright.operators import ablations

    units, signs = ["up", "down", "against", "late", "wide", "wider"], [1.0, 1.0, -1.0]
    rng = random.Random(8)
    rows = [([rng.choice([0.0, None, rng.uniform(-0.2, 0.3)]) for _ in units], rng.choice(["mixto", "otro"]), rng.uniform(0, 3), rng.uniform(1, 9), rng.uniform(1, 9), 0.5) for _ in range(60)]

    def replay(v, regime, range_pct):
        score = 0.5 + v[0] + v[1] - v[2]
        tp = min(0.74, max(0.22, min(0.74, max(0.26, score)) + v[3]))
        base = 0.12 if regime == "mixto" else 0.10 if v[2] >= 0.03 else 0.08 if range_pct < 1.2 else 0.06
        middle = min(0.22, max(0.04, min(0.20, base + v[4]) + v[5]))
        return tp, max(0.05, 1 - tp - middle), middle

    df = spark.createDataFrame(rows, "components array<double>, regime string, range_pct double, win double, loss double, cost double").repartition(3)
    got = {r["unit"]: r for r in ablations.ablations(df, units, signs, "against").collect()}
    for i, u in enumerate(units):
        want = [0] * 6
        for c, regime, range_pct, win, loss, cost in rows:
            v = [x or 0.0 for x in c]
            a, b = replay(v, regime, range_pct), replay([0.0 if j == i else x for j, x in enumerate(v)], regime, range_pct)
            ev = [p[0] * win - p[1] * loss - p[2] * cost for p in (a, b)]
            for j, hit in enumerate((v[i] != 0, *(abs(x - y) >= 0.0001 for x, y in zip(a, b, strict=True)), (ev[0] >= 0) != (ev[1] >= 0), abs(a[0] - b[0]))):
                want[j] += hit
        r = got[u]
        assert (r["cases"], r["active"], r["tp_changed"], r["sl_changed"], r["range_changed"], r["ev_sign_changed"]) == (60, *want[:5]) and r["sum_tp"] == pytest.approx(want[5])
