"""Golden values of single operators, sources and streams."""

from __future__ import annotations

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from tapewright import catalog
from tapewright.functions import probability, scalars
from tapewright.operators import bars, evidence, outcomes, reports, statistics
from tapewright.plans import library_rules, market_rules
from tapewright.sources import market
from tapewright.streaming import lifecycle

MINUTE = 60_000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_double_barrier(spark):
    even = one(spark, probability.double_barrier(F.lit(0.04), F.lit(0.04), F.lit(0.05)))
    assert abs(even["p_tp"] - even["p_sl"]) < 1e-12 and abs(sum(even) - 1) < 1e-12
    a = one(spark, probability.double_barrier(F.lit(0.02), F.lit(0.06), F.lit(0.04)))
    b = one(spark, probability.double_barrier(F.lit(0.06), F.lit(0.02), F.lit(0.04)))
    assert abs(a["p_tp"] - b["p_sl"]) < 1e-12 and abs(a["p_sl"] - b["p_tp"]) < 1e-12
    assert abs(one(spark, probability.single_barrier(F.lit(0.03), F.lit(0.02))) - math.erfc(1.5 / math.sqrt(2))) < 1e-10
    assert one(spark, probability.double_barrier(F.lit(-1.0), F.lit(0.1), F.lit(0.1))) is None


def test_competing_risks_without_evidence_keep_the_baseline(spark):
    base = one(spark, probability.double_barrier(F.lit(0.04), F.lit(0.03), F.lit(0.05)))
    same = one(spark, probability.competing_risks(F.lit(0.04), F.lit(0.03), F.lit(0.05), F.lit(0.0), F.lit(0.0), 6))
    assert all(abs(base[k] - same[k]) < 1e-9 for k in ("p_tp", "p_sl", "p_expiry"))
    more = one(spark, probability.competing_risks(F.lit(0.04), F.lit(0.03), F.lit(0.05), F.lit(0.3), F.lit(0.0), 6))
    assert more["p_tp"] > base["p_tp"] and abs(sum(more) - 1) < 1e-9


def test_competing_risk_query_against_a_recursion(spark):
    def barrier(up, down, s):
        if s == 0:
            return 0.0, 0.0, 1.0
        width = up + down
        decay = math.pi**2 / 2 * s * s / width**2
        parts = [(n, math.sin(n * math.pi * down / width) * math.exp(-decay * n * n) / n) for n in range(1, max(8, math.ceil(math.sqrt(31 / decay))) + 1)]
        tp = down / width - 2 / math.pi * sum(x if n % 2 else -x for n, x in parts)
        sl = up / width - 2 / math.pi * sum(x for _, x in parts)
        tp, sl = (min(1.0, max(0.0, x)) for x in (tp, sl))
        return tp, sl, min(1.0, max(0.0, 1 - tp - sl))

    def recursion(side, sigma):
        up, down = (math.log(1.5), -math.log(0.9)) if side == "long" else (-math.log(0.9), math.log(1.5))
        grid, tp, sl, alive = [barrier(up, down, sigma * math.sqrt(i / 24)) for i in range(25)], 0.0, 0.0, 1.0
        for before, after in zip(grid[:-1], grid[1:], strict=True):
            h = [(after[k] - before[k]) / before[2] if before[2] > 1e-10 else 0.0 for k in (0, 1)]
            w = [max(h[0], 0.0) * math.exp(0.2), max(h[1], 0.0) * math.exp(-0.1), max(1 - sum(h), 0.0)]
            tp, sl, alive = tp + alive * w[0] / sum(w), sl + alive * w[1] / sum(w), alive * w[2] / sum(w)
        return tp, sl, alive

    sf = "/root/testdata/sf0.001"
    plans = {r["plan_id"]: r for r in catalog.first_passage(spark, sf).select("plan_id", "side", "sigma").collect()}
    got = {r["plan_id"]: (r["p_tp"], r["p_sl"], r["p_expiry"]) for r in catalog.competing_risk_probabilities(spark, sf).collect()}
    assert len(plans) > 24 and got.keys() == plans.keys()
    for k, r in plans.items():
        assert got[k] == pytest.approx(recursion(r["side"], r["sigma"]), abs=2e-6)


@pytest.mark.parametrize(("side", "levels", "label", "mfe", "mae"), [("long", [(105, 98), (111, 97), (112, 99)], "take_profit", 12.0, -3.0), ("short", [(103, 96), (106, 89), (105, 97)], "ambiguous", 11.0, -6.0)])
def test_first_touch(spark, side, levels, label, mfe, mae):
    rows = [("s", i * MINUTE, float(h), float(lo), 100.0, (i + 1) * MINUTE - 1) for i, (h, lo) in enumerate(levels)]
    b = spark.createDataFrame(rows, "symbol string, open_ms long, high double, low double, close double, close_ms long")
    stop, target = (95.0, 110.0) if side == "long" else (105.0, 90.0)
    plan = spark.createDataFrame([("p", "s", 0, side, 100.0, stop, target)], "plan_id string, symbol string, at_ms long, side string, entry double, stop double, target double")
    got = outcomes.first_touch(plan, b, 10 * MINUTE).first()
    assert (got["label"], round(got["mfe"], 9), round(got["mae"], 9)) == (label, mfe, mae)


def test_economics_golden_values(spark):
    rows = [(1, "long", 100.0, 100.0, 10.0, 95.0, 100.0), (2, "short", 100.0, 100.0, 10.0, 105.0, -50.0), (3, "long", 100.0, 100.0, 10.0, 105.0, 1.0), (4, None, 1.0, 1.0, 1.0, 1.0, 1.0), (5, "long", 100.0, 100.0, 10.0, 95.0, float("nan"))]
    ops = spark.createDataFrame(rows, "operation_id long, side string, entry double, margin double, leverage double, stop_loss double, final_pnl double").withColumns({"close_reason": F.lit("take_profit"), "plan_result": F.lit("plan_success")})
    got = {r["operation_id"]: r for r in reports.normalised_economics(ops).collect()}
    assert (got[1]["notional"], got[1]["risk_pct"], got[1]["risk_amount"], got[1]["return_pct"], got[1]["margin_return_pct"], got[1]["r_multiple"]) == (1000.0, 5.0, 50.0, 10.0, 100.0, 2.0)
    assert got[2]["r_multiple"] == -1.0
    assert [got[i]["reason"] for i in (3, 4, 5)] == ["stop_not_adverse_to_long", "invalid_side", "missing_final_pnl"]


def test_drawdown_and_auc(spark):
    r = spark.createDataFrame([(1, 1.0), (2, -0.5), (3, -1.0)], "id long, r double").withColumn("k", F.lit(1))
    assert reports.max_drawdown(r, ["k"], ["id"], "r").first()["max_drawdown"] == 1.5
    s = spark.createDataFrame([(1.0, 0), (2.0, 0), (3.0, 1), (4.0, 1)], "s double, y int").withColumn("k", F.lit(1))
    assert statistics.rank_auc(s, ["k"], "s", F.col("y") == 1).first()["auc"] == 1.0
    assert statistics.rank_auc(s.withColumn("s", F.lit(1.0)), ["k"], "s", F.col("y") == 1).first()["auc"] == 0.5


def test_scalars(spark):
    assert one(spark, scalars.archive_millis(F.lit(1_700_000_000_000_000))) == 1_700_000_000_000
    assert one(spark, scalars.evidence_quality(F.lit(0), F.lit(10 * MINUTE - 1), F.lit(9))) == "partial_1m"
    assert one(spark, scalars.evidence_quality(F.lit(0), F.lit(10 * MINUTE - 1), F.lit(10))) == "complete_1m"
    assert one(spark, scalars.transition(F.lit("OPEN"), F.lit("trigger"))) is None
    assert one(spark, scalars.parse_iso(F.lit("nope"))) is None


def test_gapped_buckets_are_left_out(spark):
    rows = [("s", i * MINUTE, 1.0, 2.0, 0.5, float(i), 1.0, 1.0) for i in (0, 1, 2, 4, 5)]
    b = spark.createDataFrame(rows, "symbol string, open_ms long, open double, high double, low double, close double, volume double, quote_volume double")
    got = bars.rollup_bars(b, MINUTE, 3 * MINUTE).collect()
    assert [(r["open_ms"], r["close"], r["volume"]) for r in got] == [(0, 2.0, 3.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "k.json").write_text("\n".join(json.dumps({"symbol": "S", "kline": k}) for k in (["0", "1", "2", "0.5", "1.5", "9", "59999"], ["x"], ["60000", "1", "2", "0.5", "1.5", "9", "119999"])))
    assert [r["open_ms"] for r in market.read_klines(spark, str(tmp_path / "k.json")).orderBy("open_ms").collect()] == [0, 60000]
    lines = [f'{{"symbol": "S", "kline": [0, 1, 2, 0.5, {close}, 3, 59999]}}' for close in range(1, 40)]
    (tmp_path / "again.json").write_text("\n".join(lines))
    assert [r["close"] for r in market.read_klines(spark, str(tmp_path / "again.json")).collect()] == [39.0]
    for name, close in (("S-5m-2024-01.zip", "1.5"), ("S-5m-2024-02.zip", "7.5")):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("a.csv", f"open_time,open,high,low,close,volume,close_time\n1700000000000000,1,2,0.5,{close},3,1700000299999000\n")
    got = market.read_zip_archives(spark, str(tmp_path)).collect()
    assert [(r["symbol"], r["open_ms"], r["close"], r["close_ms"]) for r in got] == [("S", 1_700_000_000_000, 7.5, 1_700_000_299_999)]
    assert market.month_grid(spark, ["A", "B"], "2024-01-01", "2024-03-01").count() == 6


def test_first_places_of_a_board(spark):
    board = spark.createDataFrame([(1, 5.0), (2, 9.0), (3, 5.0), (4, 1.0)], "user_id long, equity double")
    assert [(r["user_id"], r["place"]) for r in reports.first_places(board, 3).collect()] == [(2, 1), (1, 2), (3, 3)]


def test_rules_defer_and_block(spark):
    pair = lambda a, b: F.create_map(F.lit("tp"), F.lit(a), F.lit("sl"), F.lit(b))
    df = spark.range(1).select(
        market_rules.expected_value(pair(0.4, 0.6), pair(10.0, -5.0), F.lit(False)).alias("early"),
        market_rules.expected_value(pair(0.4, 0.6), pair(10.0, -5.0), F.lit(True)).alias("value"),
        market_rules.expected_value(pair(0.4, 0.4), pair(10.0, -5.0), F.lit(True)).alias("mass"),
        market_rules.net_payoffs(pair(10.0, -5.0), pair(1.0, 1.0), pair(0.5, 0.5), F.create_map(F.lit("tp"), F.lit(0.0))).alias("keys"),
        market_rules.quoted_spread(F.lit(10.0), F.lit(9.0), F.lit(0), F.lit(0)).alias("crossed"),
        market_rules.compared_imbalances(F.lit(0.2), F.lit(-0.1)).alias("compared"),
    )
    r = df.first()
    assert (r["early"]["status"], r["early"]["reason"], r["early"]["value"]) == ("deferred", "m6_probabilities_unavailable", None)
    assert (r["value"]["status"], round(r["value"]["value"], 9)) == ("evaluated", 1.0)
    assert r["mass"]["reason"] == "probability_mass_not_one" and r["keys"]["reason"] == "payoff_outcome_key_mismatch" and r["crossed"]["reason"] == "crossed_book"
    assert (round(r["compared"]["difference"], 9), r["compared"]["signs"]) == (0.3, "opposite")


def test_touches_in_one_bar_are_resolved_by_trades(spark):
    plans = spark.createDataFrame([("a", "S", 99, "long", 9.0, 11.0), ("b", "S", 99, "short", 11.0, 9.0), ("c", "S", 199, "long", 9.0, 11.0)], "plan_id string, symbol string, at_ms long, side string, stop double, target double")
    bars = spark.createDataFrame([("S", 100, 199, 8.0, 12.0), ("S", 200, 299, 8.5, 12.0)], "symbol string, open_ms long, close_ms long, low double, high double")
    ticks = spark.createDataFrame([("S", 150, 2, 8.0), ("S", 150, 1, 12.0), ("S", 120, 1, 10.0), ("S", 400, 1, 8.0)], "symbol string, ts_ms long, trade_id long, price double")
    got = {r["plan_id"]: (r["reason"], r["touched_ms"]) for r in evidence.resolved_by_trades(evidence.next_bar_touches(plans, bars), ticks, 100).collect()}
    assert got == {"a": ("take_profit", 150), "b": ("stop_loss", 150), "c": ("ambiguous_same_candle", 200)}


def test_stream_of_operations(spark, tmp_path):
    schema = "operation_id long, ts_ms long, price double, side string, trigger_price double, stop double, target double, expires_ms long"
    rows = [(1, 1, 101.0, "long", 100.0, 95.0, 110.0, 99), (1, 2, 99.0, "long", 100.0, 95.0, 110.0, 99), (1, 3, 111.0, "long", 100.0, 95.0, 110.0, 99), (1, 4, 90.0, "long", 100.0, 95.0, 110.0, 99), (2, 99, 99.0, "long", 90.0, 80.0, 110.0, 99)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = lifecycle.stream_operations(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted((r["operation_id"], r["event"], r["status"]) for r in spark.table("moves").collect())
    assert got == [(1, "take_profit", "CLOSED"), (1, "trigger", "OPEN"), (2, "expire", "EXPIRED_UNFILLED")]


def test_technical_rules_against_a_recursion(spark):
    bars = [("s", i, 100 + 7 * math.sin(i / 9) + i % 4, 101.5 + 7 * math.sin(i / 9) + i % 5, 98 + 7 * math.sin(i / 9) - i % 3) for i in range(208)]
    got = library_rules.technical(spark.createDataFrame(bars, "symbol string, open_ms long, close double, high double, low double"), F.lit("short")).orderBy("open_ms").collect()
    assert [r["ema_trend"]["status"] for r in got] == ["blocked"] * 205 + ["evaluated"] * 3
    assert got[204]["ema_trend"]["reason"] == "insufficient_closed_candles_for_ema200_and_slope"
    for last in (205, 207):
        seen = bars[last - 205 : last + 1]
        closes = [b[2] for b in seen]

        def ema(period, values):
            value = sum(values[:period]) / period
            for x in values[period:]:
                value += 2 / (period + 1) * (x - value)
            return value

        def wilder(values):
            value = sum(values[:14]) / 14
            for x in values[14:]:
                value = (value * 13 + x) / 14
            return value

        moves = [b - a for a, b in zip(closes[:-1], closes[1:], strict=True)]
        ranges = [seen[0][3] - seen[0][4]] + [max(b[3] - b[4], abs(b[3] - a[2]), abs(b[4] - a[2])) for a, b in zip(seen[:-1], seen[1:], strict=True)]
        atr, up, down = wilder(ranges), wilder([max(m, 0) for m in moves]), wilder([max(-m, 0) for m in moves])
        row = got[last]
        assert row["rsi_wilder"]["rsi"] == pytest.approx(100 - 100 / (1 + up / down), rel=1e-11)
        assert row["ema_trend"]["side_slope"] == pytest.approx(-(ema(50, closes) - ema(50, closes[:-6])) / atr)
        assert row["ema_trend"]["far"] == pytest.approx(math.log(ema(50, closes) / ema(200, closes)))
        assert row["atr_extension"]["extension"] == pytest.approx((closes[-1] - ema(20, closes)) / atr)


def test_crowding_needs_periods_without_gaps(spark):
    rows = [("s", i * 60, 1.0 + i % 7) for i in range(62)] + [("t", i * 60 + (60 if i > 30 else 0), 2.0) for i in range(61)] + [("t", -60, None), ("t", -120, 0.0)]
    df = spark.createDataFrame(rows, "symbol string, open_ms long, ratio double")
    got = {(r["symbol"], r["open_ms"]): r["crowding"] for r in library_rules.crowding_relative(df, F.lit("long"), 60).collect()}
    assert len(got) == 123 and got["s", 59 * 60]["reason"] == "insufficient_current_plus_60_crowding_periods"
    assert got["t", 61 * 60]["reason"] == "gapped_crowding_history"
    last = got["s", 61 * 60]
    prior = [1.0 + i % 7 for i in range(1, 61)]
    assert last["status"] == "evaluated" and last["rank"] == pytest.approx((sum(x < 6 for x in prior) + 0.5 * prior.count(6.0)) / 60)


def test_book_imbalance_of_odd_books(spark):
    rows = [(1, True, 99.0, 2.0), (1, True, 99.0, 5.0), (1, False, 101.0, 1.0), (1, False, 0.0, 9.0), (2, True, 5.0, 1.0), (3, True, 7.0, 1.0), (3, False, 6.0, 1.0)]
    got = {r["id"]: r["book"] for r in library_rules.book_imbalance(spark.createDataFrame(rows, "id long, bid boolean, price double, qty double"), "id", F.lit("short"), top=(1,)).collect()}
    assert got[1]["top_1"] == pytest.approx((495 - 101) / 596) and got[1]["side_top_1"] == -got[1]["top_1"] and got[1]["within_10bps"] is None
    assert [got[k]["status"] for k in (1, 2, 3)] == ["evaluated", "blocked", "blocked"]


def test_structural_levels_against_brute_force(spark):
    bars = [("s", i, 100 + 9 * math.sin(i * 1.3) + i % 4, 102.5 + 9 * math.sin(i * 1.3) + i % 5, 97.5 + 9 * math.sin(i * 1.3) - i % 3) for i in range(30)]
    df = spark.createDataFrame(bars, "symbol string, open_ms long, close double, high double, low double")
    plans = df.withColumns({"side": F.lit("short"), "entry": F.col("close"), "target": F.col("close") * 0.9, "stop": F.col("close") * 1.1})
    got = library_rules.structural_levels(plans, 4).orderBy("open_ms").collect()
    assert [r["structure"]["status"] for r in got] == ["blocked"] * 15 + ["evaluated"] * 15
    for last in range(15, 30):
        seen, entry = bars[last - 15 : last + 1], bars[last][2]
        found = []
        for i in range(3, 13):
            left, right, (_, _, _, high, low) = seen[i - 3 : i], seen[i + 1 : i + 4], seen[i]
            ways = []
            if all(high > b[3] for b in left + right):
                ways.append((high - max(min(b[4] for b in left), min(b[4] for b in right)), "high", high))
            if all(low < b[4] for b in left + right):
                ways.append((min(max(b[3] for b in left), max(b[3] for b in right)) - low, "low", low))
            if ways:
                found.append(max(ways, key=lambda w: w[0]))
        s, z = got[last]["structure"], got[last]["zone"]
        assert s["pivots"] == len(found)
        assert s["target_path"] == sum(kind == "low" and entry * 0.9 < p < entry for _, kind, p in found)
        assert s["stop_path"] == sum(kind == "high" and entry < p < entry * 1.1 for _, kind, p in found)
        above = [p for _, kind, p in found if kind == "high" and p > entry]
        assert z["level_type"] == "resistance" and z["level"] == (min(above) if above else None) == s["resistance"]


def test_zones_and_roles_of_odd_orders(spark):
    cluster = F.array(F.struct(F.lit(101.0).alias("price"), F.lit(5.0).alias("notional")))
    none = cluster.cast("array<struct<price:double,notional:double>>")
    zone = lambda side, target, stop, above: library_rules.liquidation_zone(F.lit(side), F.lit(100.0), F.lit(target), F.lit(stop), F.lit(0.02), above, F.filter(none, lambda c: F.lit(False)))
    good = one(spark, zone("long", 103.0, 99.0, cluster))
    assert good["target_mass"] == 5 and good["stop_count"] == 0 and good["target_share"] == 1 and good["nearest_target"] == 101
    assert one(spark, zone("long", 100.5, 99.0, cluster))["target_share"] is None
    assert one(spark, zone("short", 103.0, 99.0, cluster))["reason"] == "invalid_barrier_geometry"
    assert one(spark, zone("long", 103.0, 99.0, F.when(F.lit(False), cluster)))["reason"] == "missing_liquidation_context"
    gone = F.lit(None).cast("double")
    assert one(spark, library_rules.flow_dual_role(F.lit("long"), {"flow": gone}, {"crowd": gone}))["status"] == "blocked"
    assert one(spark, library_rules.flow_dual_role(F.lit("long"), {"flow": F.lit(0.5)}, {"crowd": gone}))["flow_activation"] == -0.5


def test_required_bars():
    assert library_rules.required_bars(86400, 3600) == 61 * 24 + 1
