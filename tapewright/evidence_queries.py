"""Queries of the evidence, gates, partitions, stage curves and scalar functions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _BARS, HOUR, hourly, query, rounded, trades
from tapewright.functions import probability as P
from tapewright.functions import predicates, scalars
from tapewright.operators import evidence
from tapewright.rule_queries import _CASES, cases
from tapewright.storage import stored

#: Sampling intervals in seconds, and periods by name.
INTERVALS = (60, 180, 300, 900, 1800, 3600, 14_400)
PERIODS = {"5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14_400, "6h": 21_600, "12h": 43_200, "1d": 86_400}


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("priority"))


_O = "o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS priority FROM orders)"
_TOUCHED = (
    _BARS
    + """, p AS (SELECT symbol || '/' || open_ms AS plan_id, symbol, close_ms AS at_ms, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 'long' ELSE 'short' END AS side, close * 0.95::DOUBLE AS down, close * 1.05::DOUBLE AS up FROM bars
), m AS (SELECT p.plan_id, p.symbol, p.side, p.down, p.up, b.open_ms, b.close_ms, b.low <= p.down AS lo, b.high >= p.up AS hi FROM p JOIN bars b ON b.symbol = p.symbol AND b.open_ms = p.at_ms + 1
), t AS (SELECT *, CASE WHEN lo AND hi THEN 'both' WHEN lo THEN CASE WHEN side = 'long' THEN 'stop_loss' ELSE 'take_profit' END WHEN hi THEN CASE WHEN side = 'long' THEN 'take_profit' ELSE 'stop_loss' END ELSE 'none' END AS touched FROM m)"""
)


@query(
    f"""WITH {_TOUCHED}, f AS (SELECT t.plan_id, arg_min(CASE WHEN (x.price <= t.down) = (side = 'long') THEN 'stop_loss' ELSE 'take_profit' END, x.ts_ms * 1000000 + x.trade_id) AS reason, min(x.ts_ms) AS ts_ms
  FROM t JOIN trades x ON x.symbol = t.symbol AND x.ts_ms BETWEEN t.open_ms AND t.close_ms AND (x.price <= t.down OR x.price >= t.up) WHERE touched = 'both' GROUP BY t.plan_id)
SELECT t.plan_id, t.symbol, touched, CASE touched WHEN 'both' THEN coalesce(f.reason, 'ambiguous_same_candle') WHEN 'none' THEN NULL ELSE touched END AS reason,
  CASE WHEN touched = 'both' THEN coalesce(f.ts_ms, open_ms) WHEN touched <> 'none' THEN open_ms END AS touched_ms FROM t LEFT JOIN f USING (plan_id)"""
)
def resolved_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plan's next bar touches first; bars that touch both levels are resolved by their trades."""
    bars = stored(hourly(spark, sf_dir), "bars")
    return evidence.resolved_by_trades(evidence.next_bar_touches(close_plans(bars, 0.05), bars), trades(spark, sf_dir), HOUR)


def close_plans(bars: DataFrame, share: float) -> DataFrame:
    """Plans at every bar's close with both levels a share away, long and short by turns."""
    long = F.pmod(F.col("open_ms") / HOUR, F.lit(2)) == 0
    down, up = F.col("close") * (1 - share), F.col("close") * (1 + share)
    return bars.select(F.concat_ws("/", "symbol", F.col("open_ms").cast("string")).alias("plan_id"), "symbol", F.col("close_ms").alias("at_ms"), F.when(long, "long").otherwise("short").alias("side"), F.when(long, down).otherwise(up).alias("stop"), F.when(long, up).otherwise(down).alias("target"))


@query(
    f"""WITH {_BARS}, p AS (SELECT symbol || '/' || open_ms AS plan_id, symbol, close_ms AS at_ms, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 'long' ELSE 'short' END AS side, close * 0.75::DOUBLE AS down, close * 1.25::DOUBLE AS up FROM bars
), h AS (SELECT p.*, b.open_ms, b.close_ms, b.low <= down AS lo, b.high >= up AS hi, row_number() OVER (PARTITION BY plan_id ORDER BY b.close_ms) AS r FROM p JOIN bars b ON b.symbol = p.symbol AND b.close_ms > p.at_ms AND b.close_ms <= p.at_ms + 86400000 WHERE b.low <= down OR b.high >= up
), t AS (SELECT *, CASE WHEN lo AND hi THEN 'both' WHEN lo = (side = 'long') THEN 'stop_loss' ELSE 'take_profit' END AS touched FROM h WHERE r = 1
), f AS (SELECT t.plan_id, arg_min(CASE WHEN (x.price <= t.down) = (side = 'long') THEN 'stop_loss' ELSE 'take_profit' END, x.ts_ms * 1000000 + x.trade_id) AS reason, min(x.ts_ms) AS ts_ms
  FROM t JOIN trades x ON x.symbol = t.symbol AND x.ts_ms BETWEEN t.open_ms AND t.close_ms AND (x.price <= t.down OR x.price >= t.up) WHERE touched = 'both' GROUP BY t.plan_id)
SELECT t.plan_id, t.symbol, touched, CASE touched WHEN 'both' THEN coalesce(f.reason, 'ambiguous_same_candle') ELSE touched END AS reason, CASE WHEN touched = 'both' THEN coalesce(f.ts_ms, open_ms) ELSE open_ms END AS touched_ms FROM t LEFT JOIN f USING (plan_id)"""
)
def path_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each plan touches first within a day, on whatever bar that is; bars that touch both levels are resolved by their trades."""
    bars = stored(hourly(spark, sf_dir), "bars")
    return evidence.resolved_by_trades(evidence.path_touches(close_plans(bars, 0.25), bars, 24 * HOUR), trades(spark, sf_dir), HOUR)


@query(
    f"""WITH {_BARS}, d AS (SELECT *, open_ms // 86400000 AS day FROM bars WHERE n_trades % 97 <> 0), e AS (SELECT *, open_ms - lag(open_ms) OVER (PARTITION BY symbol, day ORDER BY open_ms) AS step FROM d
), g AS (SELECT symbol, day, count(*) AS bars, count(*) FILTER (NOT (least(open, high, low, close) > 0 AND volume >= 0)) AS bad_values, count(*) FILTER (high < greatest(open, close) OR low > least(open, close)) AS bad_ranges,
  count(*) FILTER (close_ms - open_ms + 1 <> 3600000) AS bad_durations, count(*) FILTER (step = 0) AS repeats, count(*) FILTER (step > 3600000) AS gaps FROM e GROUP BY symbol, day)
SELECT *, CASE WHEN bars >= 24 AND bad_values + bad_ranges + bad_durations + repeats + gaps = 0 THEN 'approved' ELSE 'rejected' END AS status FROM g"""
)
def candle_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate on each symbol's bars of a day, some of which are taken out."""
    bars = hourly(spark, sf_dir).where(F.col("n_trades") % 97 != 0).withColumn("day", F.floor(F.col("open_ms") / (24 * HOUR)))
    return evidence.candle_gate(bars, ["symbol", "day"], HOUR, 24)


@query(
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS provider_ms FROM events), o AS (
  SELECT event_id, user_id % 500 AS analysis, CASE WHEN event_id % 19 <> 0 THEN provider_ms END AS provider_ms, CASE WHEN event_id % 23 <> 0 THEN provider_ms - event_id % 7 * 10 END AS asked_ms, provider_ms + event_id % 11 * 20 - 40 AS received_ms, provider_ms + event_id % 13 * 5000 AS analysis_ms FROM e
), p AS (SELECT *, CASE WHEN asked_ms IS NULL THEN 'missing_time' WHEN received_ms < asked_ms THEN 'received_before_request' WHEN received_ms > analysis_ms THEN 'received_after_analysis' WHEN provider_ms > received_ms THEN 'provider_time_after_receipt'
  WHEN analysis_ms - coalesce(provider_ms, received_ms) > 30000 THEN 'stale' END AS problem FROM o)
SELECT analysis, count(*) AS n, count(*) FILTER (provider_ms IS NULL) AS untimed, max(received_ms) - min(received_ms) AS span_ms, max(received_ms) - min(received_ms) <= 86400000 AS together,
  count(*) FILTER (problem = 'missing_time') AS missing_time, count(*) FILTER (problem = 'received_before_request') AS early, count(*) FILTER (problem = 'received_after_analysis') AS late,
  count(*) FILTER (problem = 'provider_time_after_receipt') AS odd, count(*) FILTER (problem = 'stale') AS stale FROM p GROUP BY analysis"""
)
def observation_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and age of observations, and the span of each analysis's receipts."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at"))
    k, at = F.col("event_id"), F.col("at")
    o = e.select((F.col("user_id") % 500).alias("analysis"), F.when(k % 19 != 0, at).alias("provider_ms"), F.when(k % 23 != 0, at - k % 7 * 10).alias("asked_ms"), (at + k % 11 * 20 - 40).alias("received_ms"), (at + k % 13 * 5000).alias("analysis_ms"))
    o = o.withColumn("problem", evidence.observation_problem(*[F.col(c) for c in ("provider_ms", "asked_ms", "received_ms", "analysis_ms")], F.lit(30_000)))
    names = {"missing_time": "missing_time", "early": "received_before_request", "late": "received_after_analysis", "odd": "provider_time_after_receipt", "stale": "stale"}
    found = o.groupBy("analysis").agg(*[F.count_if(F.col("problem") == v).alias(n) for n, v in names.items()])
    return evidence.capture_spans(o, "analysis", 86_400_000).join(found, "analysis")


@query(
    f"""WITH {_O}, d AS (SELECT list(DISTINCT day ORDER BY day) AS days FROM o), c AS (SELECT days, len(days) AS n, greatest(0, least(len(days) - 3, CAST(floor(len(days) * 0.6) AS INT) - 1)) AS i FROM d
), e AS (SELECT days[i + 1] AS d1, days[greatest(i + 1, least(n - 2, CAST(floor(n * 0.8) AS INT) - 1)) + 1] AS d2 FROM c
), r AS (SELECT CASE WHEN day <= d1 THEN 'development' WHEN day <= d2 THEN 'calibration' ELSE 'final_test' END AS part, priority, k % 3 = 0 AS odd_key, k % 5 = 0 AS fifth FROM o, e
), g AS (SELECT part, priority FROM (SELECT unnest(['development', 'calibration', 'final_test']) AS part) AS a, (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', 'none']) AS priority) AS b)
SELECT g.part, g.priority, count(r.part) AS n, count(*) FILTER (odd_key AND fifth) AS both_wrong FROM g LEFT JOIN r ON g.part = r.part AND g.priority = r.priority GROUP BY g.part, g.priority"""
)
def partition_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each partition by date and priority, with those that fail both checks; combinations without rows count 0."""
    o = orders(spark, sf_dir)
    ends = [F.lit(d) for d in evidence.date_cuts(o, "day").first() or (None, None)]  # two dates
    wrong = evidence.problems({"key": F.col("k") % 3 != 0, "fifth": F.col("k") % 5 != 0})
    rows = o.select(evidence.partition_of(F.col("day"), *ends).alias("part"), "priority", wrong.alias("wrong"))
    axes = {"part": ["development", "calibration", "final_test"], "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "none"]}
    bad = evidence.dense_counts(rows.where(F.size("wrong") == 2).select("part", "priority"), axes).withColumnRenamed("n", "both_wrong")
    return evidence.dense_counts(rows, axes).join(bad, list(axes))


@query(
    f"""WITH {_CASES}, a AS (SELECT k, n_trades AS nt, volume AS vol_, tp / 2 AS a1, sl / 3 AS b1, wins / 60.0::DOUBLE AS a2, losses / 50.0::DOUBLE AS b2, n_trades / (n_trades + 3.0::DOUBLE) AS act, entry AS price, coalesce(prev, entry) AS entry,
    CASE n_trades WHEN 1 THEN NULL WHEN 2 THEN 'price_lte' ELSE 'price_gte' END AS trg FROM c
), b AS (SELECT *, 1 - a1 - b1 AS s1, a1 + (1 - a1 - b1) * a2 AS tp2, b1 + (1 - a1 - b1) * b2 AS sl2 FROM a)
SELECT k, round(s1, 9) AS none1, round(tp2, 9) AS tp2, round(sl2, 9) AS sl2, round(1 - tp2 - sl2, 9) AS none2, CASE WHEN s1 > 0 THEN round(a2, 9) END AS back_tp, round(act * a1, 9) AS tree_tp, round(act * (1 - a1 - b1) + 1 - act, 9) AS tree_unresolved,
  abs(a1 + b1 + s1 - 1) <= 1e-9 AND a1 >= 0 AND b1 >= 0 AND s1 >= 0 AND nt <> 3 AS fair, round(0.1::DOUBLE + 0.5::DOUBLE * a1 - 2 * b1, 9) AS predictor, round(0.5::DOUBLE * (a1 - 0.2::DOUBLE) / 0.1::DOUBLE, 9) AS part_a,
  round(vol_ / (vol_ + 25.0::DOUBLE) * 0.8::DOUBLE + (1 - vol_ / (vol_ + 25.0::DOUBLE)) * 0.5::DOUBLE, 9) AS pooled_a,
  CASE WHEN trg IS NULL THEN 'active_at_analysis' WHEN trg = 'price_lte' AND price <= entry OR trg = 'price_gte' AND price >= entry THEN 'pending_trigger_already_satisfied' ELSE 'waiting_for_trigger' END AS activation,
  CASE WHEN trg IS NULL THEN 0 WHEN NOT (trg = 'price_lte' AND price <= entry OR trg = 'price_gte' AND price >= entry) THEN round(abs(ln(entry / price)) / 0.05::DOUBLE, 9) END AS activation_z,
  arg_min_period AS period FROM b JOIN (SELECT h, first(name ORDER BY round(abs(ln(h / s)), 12), -s) AS arg_min_period FROM (SELECT DISTINCT nt * 3600.0::DOUBLE AS h FROM a) AS hs,
  (SELECT unnest(['5m', '15m', '30m', '1h', '2h', '4h', '6h', '12h', '1d']) AS name, unnest([300, 900, 1800, 3600, 7200, 14400, 21600, 43200, 86400]) AS s) AS ps GROUP BY h) AS near ON near.h = nt * 3600.0::DOUBLE"""
)
def stage_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages to curves and back, trees, predictors, pooling, resting entries and nearest periods of each case."""
    nt = F.col("nt")
    o = cases(spark, sf_dir).select("k", F.col("n_trades").alias("nt"), F.col("volume").alias("vol_"), (F.col("tp") / 2).alias("a1"), (F.col("sl") / 3).alias("b1"), (F.col("wins") / 60.0).alias("a2"), (F.col("losses") / 50.0).alias("b2"), (F.col("n_trades") / (F.col("n_trades") + 3.0)).alias("act"), F.col("entry").alias("price"), F.coalesce("prev", "entry").alias("entry"))
    stage = lambda tp, sl: F.struct(tp.alias("tp"), sl.alias("sl"), (1 - tp - sl).alias("none"))
    o = o.withColumn("curve", P.cumulative_stages(F.array(stage(F.col("a1"), F.col("b1")), stage(F.col("a2"), F.col("b2")))))
    o = o.withColumn("back", P.conditional_stages(F.col("curve")))
    first = F.element_at("curve", 1)
    spread = F.create_map(F.lit("tp"), F.col("a1"), F.when(nt == 3, "other").otherwise("sl"), F.col("b1"), F.lit("none"), first["none"])
    maps = lambda **v: F.create_map(*[x for n, c in v.items() for x in (F.lit(n), c if not isinstance(c, float) else F.lit(c))])
    features = maps(a=F.col("a1"), b=F.col("b1"))
    trigger = F.when(nt == 2, "price_lte").when(nt > 2, "price_gte")
    way = P.activation_distance(F.lit("long"), trigger, F.col("price"), F.col("entry"), F.lit(0.05))
    out = o.select(
        "k",
        first["none"].alias("none1"),
        F.element_at("curve", 2)["tp"].alias("tp2"),
        F.element_at("curve", 2)["sl"].alias("sl2"),
        F.element_at("curve", 2)["none"].alias("none2"),
        F.element_at("back", 2)["tp"].alias("back_tp"),
        (F.col("act") * F.col("a1")).alias("tree_tp"),
        (F.col("act") * first["none"] + 1 - F.col("act")).alias("tree_unresolved"),
        P.is_distribution(spread, ["tp", "sl", "none"]).alias("fair"),
        P.linear_predictor(maps(intercept=0.1, a=0.5, b=-2.0), features).alias("predictor"),
        P.contributions(maps(a=0.5, b=-2.0), features, maps(a=0.2, b=0.1), maps(a=0.1, b=0.0))["a"].alias("part_a"),
        P.pooled(maps(a=0.5), maps(a=0.8), F.col("vol_"), 25.0)["a"].alias("pooled_a"),
        way["status"].alias("activation"),
        way["z"].alias("activation_z"),
        P.nearest_period(PERIODS, nt * 3600.0).alias("period"),
    )
    return rounded(out, 9)


@query(
    f"""WITH {_O}, a AS (SELECT *, CAST(day AS TIMESTAMP) + to_seconds(k % 5000) AS t0, CAST(day AS TIMESTAMP) + to_seconds(k % 9000) AS t1, '{{"a":{{"b":' || (k % 90) || ',"c":"x' || (k % 3) || '"}},"d":' || CASE WHEN k % 4 = 0 THEN 'null' ELSE (k % 11)::VARCHAR END || '}}' AS raw FROM o)
SELECT k, strftime(make_timestamp(1700000000000000 + k % 1000000 * 1001000), '%Y-%m-%dT%H:%M:%S.%g+00:00') AS iso, round(epoch_us(t1) / 60000000.0::DOUBLE - epoch_us(t0) / 60000000.0::DOUBLE, 2) AS minutes, strftime(day, '%Y-%m') AS season, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS starts,
  CAST(CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS ends, CASE WHEN k % 2 = 0 THEN 1600000000000 + k END AS banned, CASE WHEN k % 3 = 0 THEN epoch_ms(t0) END AS noted, list_max(list_filter([60, 180, 300, 900, 1800, 3600, 14400], lambda i: (k % 9 + 1) * 1800 % i = 0 AND (k % 9 + 1) * 1800 >= i * 24)) AS sampling,
  CASE k % 5 WHEN 0 THEN 'market' WHEN 1 THEN CASE WHEN k % 2 = 0 THEN 'limit_pullback' ELSE 'stop_breakdown' END WHEN 2 THEN CASE WHEN k % 2 = 1 THEN 'limit_pullback' ELSE 'stop_breakout' END ELSE 'market' END AS order_type,
  CASE WHEN k % 6 = 0 THEN 0 ELSE round((k % 25) / (k % 6)::DOUBLE * 100, 6) END AS share, regexp_replace(printf('%.3f', (k % 40) / 20.0::DOUBLE), '\\.?0+$', '') AS level, 'x' || (k % 3) AS field, CASE WHEN k % 4 = 0 THEN -1 ELSE (k % 11)::DOUBLE END AS number,
  k % 90 + CASE WHEN k % 4 = 0 THEN 0 ELSE k % 11 END::DOUBLE AS flat_sum, sha256('{{"day":"' || day || '","k":' || k || ',"none":null}}') AS digest, CASE k % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' END AS image FROM a"""
)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times, texts and JSON fields of each order."""
    o, k, at = orders(spark, sf_dir), F.col("k"), F.col("day").cast("timestamp_ntz").cast("timestamp")
    seconds = lambda n: F.timestamp_micros(F.unix_micros(at) + k % n * 1_000_000)
    raw = F.concat(F.lit('{"a":{"b":'), (k % 90).cast("string"), F.lit(',"c":"x'), (k % 3).cast("string"), F.lit('"},"d":'), F.when(k % 4 == 0, "null").otherwise((k % 11).cast("string")), F.lit("}"))
    o = o.withColumns({"t0": seconds(5000), "t1": seconds(9000), "raw": raw})
    season = scalars.month_season(F.col("day"))
    note = F.when(k % 3 == 0, F.concat(F.lit("cierre en vela "), F.date_format("t0", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" por stop"))).otherwise("sin marca")
    side, trigger = F.when(k % 2 == 0, "long").otherwise("short"), F.when(k % 5 == 1, "price_lte").when(k % 5 == 2, "price_gte")
    flat = F.aggregate(F.map_values(scalars.flat_numbers(F.col("raw"), ["a.b", "a.c", "d"])), F.lit(0.0), lambda x, v: x + v)
    image = F.when(k % 3 == 0, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k % 3 == 1, F.unhex(F.lit("FFD8FFE000"))).otherwise(F.unhex(F.lit("00")))
    return o.select(
        "k",
        scalars.iso_of_millis(F.lit(1_700_000_000_000) + k % 1_000_000 * 1001).alias("iso"),
        scalars.minutes_between(F.col("t0"), F.col("t1")).alias("minutes"),
        season["code"].alias("season"),
        season["starts"].cast("string").alias("starts"),
        season["ends"].cast("string").alias("ends"),
        scalars.ban_until(F.when(k % 2 == 0, F.concat(F.lit("IP banned until "), (k + 1_600_000_000_000).cast("string"), F.lit("."))).otherwise("ok")).alias("banned"),
        scalars.millis(scalars.note_stamp(note)).alias("noted"),
        scalars.sampling_interval((k % 9 + 1) * 1800, INTERVALS).alias("sampling"),
        scalars.order_type(side, trigger).alias("order_type"),
        F.round(scalars.relative((k % 25).cast("double"), (k % 6).cast("double")), 6).alias("share"),
        scalars.level_name(k % 40 / 20.0).alias("level"),
        scalars.json_field(F.col("raw"), "$.a.c").alias("field"),
        scalars.preferred_number(F.col("raw"), "$.d", F.lit(-1.0)).alias("number"),
        flat.alias("flat_sum"),
        scalars.payload_digest({"k": k, "none": F.lit(None).cast("long"), "day": F.col("day")}).alias("digest"),
        scalars.image_type(image).alias("image"),
    )


_RESULTS = f"""WITH {_O}, a AS (SELECT k, CASE WHEN k % 2 = 0 THEN 'long' ELSE 'short' END AS side, CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS s, (k % 30 + 80)::DOUBLE AS price, CASE WHEN k % 31 = 0 THEN 0 ELSE (k % 23 + 84)::DOUBLE END AS entry, (k % 23 + 84)::DOUBLE AS e0, priority,
  ['take_profit', 'stop_loss', 'manual', 'contest_expired'][k % 4 + 1] AS reason, ['manual_protected', 'manual_left_profit', 'manual_better_than_plan', 'manual_worse_than_plan', 'plan_unresolved', 'other'][k % 6 + 1] AS seen,
  ['take_profit', 'stop_loss', 'no_plan_touch', 'ambiguous_same_candle', 'stop_loss'][k % 5 + 1] AS touch, ['take_profit', 'stop_loss', 'no_plan_touch', 'ambiguous_boundary_candle', NULL, 'take_profit', 'stop_loss'][k % 7 + 1] AS later FROM o
), b AS (SELECT *, e0 - s * CASE WHEN k % 13 = 0 THEN -3 ELSE 3 END AS stop, e0 + s * 4 AS target, CASE WHEN (k % 2 = 0) = (k % 9 <> 0) THEN 'price_lte' ELSE 'price_gte' END AS trg FROM a)"""


@query(
    _RESULTS
    + """ SELECT k, CASE WHEN entry <= 0 THEN 'invalid_price' WHEN k % 9 = 0 THEN 'limit_v1_supports_pullback_orders_only' WHEN NOT s * (price - entry) > 0 THEN 'limit_trigger_already_satisfied' WHEN NOT (s * (entry - stop) > 0 AND s * (target - entry) > 0) THEN 'invalid_barrier_geometry' END AS problem,
  CASE WHEN entry > 0 AND s * ln(price / entry) > 0 THEN round(s * ln(price / entry), 9) END AS distance, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 15 = 0 THEN 1 ELSE 0 END AS missing,
  CASE WHEN k % 8 = 0 THEN 'side_differs' WHEN k % 12 = 0 THEN 'priority_differs' END AS differs,
  CASE WHEN touch LIKE 'ambiguous%' THEN 'ambiguous' WHEN reason IN ('take_profit', 'stop_loss') THEN CASE WHEN touch = reason THEN 'consistent' ELSE 'mismatch' END WHEN seen = 'other' OR later IS NULL THEN 'not_comparable' WHEN later LIKE 'ambiguous%' THEN 'ambiguous'
    WHEN later = CASE WHEN seen IN ('manual_protected', 'manual_worse_than_plan') THEN 'stop_loss' WHEN seen = 'plan_unresolved' THEN 'no_plan_touch' ELSE 'take_profit' END THEN 'consistent' ELSE 'mismatch' END AS agreement,
  CASE WHEN reason = 'contest_expired' THEN 'contest_expiry_mark_to_market' WHEN reason <> 'manual' THEN CASE touch WHEN 'take_profit' THEN 'plan_success' WHEN 'stop_loss' THEN 'plan_failure' WHEN 'no_plan_touch' THEN 'plan_unresolved' ELSE 'ambiguous_same_candle' END
    WHEN later IS NULL THEN 'manual_pending_or_unclassified' ELSE CASE later WHEN 'take_profit' THEN 'plan_would_succeed' WHEN 'stop_loss' THEN 'plan_would_fail' WHEN 'no_plan_touch' THEN 'plan_unresolved' ELSE 'ambiguous_same_candle' END END AS result,
  CASE WHEN k % 20 <> 0 AND k % 5 + k % 4 + k % 3 > 0 THEN round(k % 5 / (k % 5 + k % 4 + k % 3)::DOUBLE, 9) END AS share, CASE WHEN k % 3 = 0 THEN 'closed_at,final_pnl' WHEN k % 3 = 1 THEN 'final_pnl' ELSE '' END AS later_keys,
  CASE WHEN k % 100 <= 30 THEN 'development' WHEN k % 100 <= 60 THEN 'calibration' WHEN k % 100 <= 80 THEN 'final_test' END AS period FROM b"""
)
def plan_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals of resting orders, missing and differing fields, agreement with evidence, and reconstructed results of each order."""
    o, k = orders(spark, sf_dir), F.col("k")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))
    long = k % 2 == 0
    s, e0 = F.when(long, 1).otherwise(-1), (k % 23 + 84).cast("double")
    o = o.withColumns(
        {
            "side": F.when(long, "long").otherwise("short"),
            "price": (k % 30 + 80).cast("double"),
            "entry": F.when(k % 31 == 0, 0.0).otherwise(e0),
            "stop": e0 - s * F.when(k % 13 == 0, -3).otherwise(3),
            "target": e0 + s * 4,
            "trg": F.when(long == (k % 9 != 0), "price_lte").otherwise("price_gte"),
            "reason": pick(("take_profit", "stop_loss", "manual", "contest_expired")),
            "seen": pick(("manual_protected", "manual_left_profit", "manual_better_than_plan", "manual_worse_than_plan", "plan_unresolved", "other")),
            "touch": pick(("take_profit", "stop_loss", "no_plan_touch", "ambiguous_same_candle", "stop_loss")),
            "later": pick(("take_profit", "stop_loss", "no_plan_touch", "ambiguous_boundary_candle", None, "take_profit", "stop_loss")),
        }
    )
    c = lambda *names: [F.col(n) for n in names]
    other = {"side": F.when(k % 8 == 0, "none").otherwise(F.col("side")), "priority": F.when(k % 12 == 0, None).otherwise(F.col("priority"))}
    missing = predicates.missing_fields({"a": F.when(k % 10 != 0, k), "b": F.when(k % 15 == 0, "").otherwise("x")})
    raw = F.when(k % 3 == 0, '{"a": {"final_pnl": 1, "b": "x"}, "closed_at" : null}').when(k % 3 == 1, '{"a": [{"final_pnl": 1}], "b": "closed_at"}').otherwise('{"a": "final_pnl"}')
    shares = predicates.normalised([F.when(k % 20 != 0, (k % 5).cast("double")), (k % 4).cast("double"), (k % 3).cast("double")])
    out = o.select(
        "k",
        predicates.limit_plan_problem(*c("side", "price", "entry", "stop", "target", "trg")).alias("problem"),
        predicates.limit_distance(F.col("side"), F.col("price"), F.nullif(F.col("entry"), F.lit(0.0))).alias("distance"),
        F.size(missing).alias("missing"),
        predicates.recommendation_problem({n: F.col(n) for n in other}, other).alias("differs"),
        predicates.consistency(*c("reason", "seen", "touch", "later")).alias("agreement"),
        predicates.reconstructed_result(*c("reason", "touch", "later")).alias("result"),
        shares[0].alias("share"),
        F.array_join(predicates.keys_in_json(raw, ("final_pnl", "closed_at", "close_price")), ",").alias("later_keys"),
        predicates.period_of(k % 100, {"development": 30, "calibration": 60, "final_test": 80}).alias("period"),
    )
    return rounded(out, 9)
