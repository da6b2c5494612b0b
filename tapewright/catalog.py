"""Registry of the market queries over the driver's tables, and of their SQL twins.

The event table serves as trades, orders as operations. Results are rounded where sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions import probability, scalars
from tapewright.operators import bars as B
from tapewright.operators import indicators as I
from tapewright.operators import analogs, joins, levels, outcomes, reports, statistics
from tapewright.plans import rules
from tapewright.sources.market import trades_of_events
from tapewright.storage import stored

HOUR = 3_600_000
DAY = 24 * HOUR

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import tapewright.ablation_queries  # noqa: F401  (these register their queries here)
    import tapewright.audit_queries  # noqa: F401
    import tapewright.engine_queries  # noqa: F401
    import tapewright.evidence_queries  # noqa: F401
    import tapewright.fitting_queries  # noqa: F401
    import tapewright.inference_queries  # noqa: F401
    import tapewright.library_queries  # noqa: F401
    import tapewright.overlay_queries  # noqa: F401
    import tapewright.rule_queries  # noqa: F401

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()

    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_touch_outcomes(spark, sf_dir)


def rounded(df: DataFrame, places: int = 6, *, but: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in but else F.col(c) for c, t in df.dtypes])


# ---- the tables as market data


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.rollup_trades(trades(spark, sf_dir), HOUR)


def plans_of(bars: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A plan at the close of every bar, long and short by turns; keep names columns of bars to carry on."""
    long = F.pmod(F.col("open_ms") / HOUR, F.lit(2)) == 0
    near, far = F.col("close") * 0.9, F.col("close") * 1.5
    return bars.select(
        F.concat_ws("/", "symbol", F.col("open_ms").cast("string")).alias("plan_id"),
        "symbol",
        F.col("close_ms").alias("at_ms"),
        F.when(long, "long").otherwise("short").alias("side"),
        F.col("close").alias("entry"),
        F.when(long, near).otherwise(far).alias("stop"),
        F.when(long, far).otherwise(near).alias("target"),
        *keep,
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as simulated operations, some of them invalid."""
    k = F.col("o_orderkey")
    entry = (k % 50 + 100).cast("double")
    side = F.when(k % 2 == 0, "long").otherwise("short")
    against = F.when(k % 11 == 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.alias("operation_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("symbol"),
        side.alias("side"),
        entry.alias("entry"),
        F.when(k % 13 == 0, 0.0).otherwise((k % 5 * 50 + 100).cast("double")).alias("margin"),
        (k % 10 + 1).cast("double").alias("leverage"),
        F.when(side == "long", entry - 5 * against).otherwise(entry + 5 * against).alias("stop_loss"),
        F.when(k % 17 == 0, None).otherwise((F.col("o_totalprice") - 250_000) / 1000).alias("final_pnl"),
        pick(("take_profit", "stop_loss", "manual", "time_expired", "contest_expired", "other_reason"), 6).alias("close_reason"),
        pick(("plan_success", "plan_failure", "ambiguous_same_candle", "expired_mark_to_market", "unresolved", "none"), 6).alias("plan_result"),
        F.when(F.col("o_orderstatus") == "F", "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("PENDING_ENTRY").alias("status"),
        F.col("o_orderdate").alias("closed_at"),
        F.array(F.concat(F.lit("lev"), (k % 4).cast("string")), F.concat(F.lit("day"), (k % 7).cast("string")), F.concat(F.lit("lev"), (k % 3).cast("string"))).alias("signals"),
    )


_TRADES = """trades AS (
  SELECT event_type AS symbol, epoch_us(ts) // 1000 AS ts_ms, event_id AS trade_id, user_id, value + 100 AS price,
         CAST(event_id % 7 + 1 AS DOUBLE) AS qty, event_id % 2 = 1 AS maker
  FROM events)"""
_BARS = (
    _TRADES
    + """, bars AS (
  SELECT symbol, ts_ms - ts_ms % 3600000 AS open_ms, arg_min(price, ts_ms * 1000000 + trade_id) AS open, max(price) AS high,
         min(price) AS low, arg_max(price, ts_ms * 1000000 + trade_id) AS close, sum(qty) AS volume, sum(price * qty) AS quote_volume,
         sum(CASE WHEN NOT maker THEN price * qty ELSE 0 END) AS taker_buy_quote, count(*) AS n_trades,
         ts_ms - ts_ms % 3600000 + 3599999 AS close_ms
  FROM trades GROUP BY symbol, ts_ms - ts_ms % 3600000)"""
)
_CHANGES = (
    _BARS
    + """, moved AS (
  SELECT *, row_number() OVER t AS n, lag(close) OVER t AS prior FROM bars WINDOW t AS (PARTITION BY symbol ORDER BY open_ms)
), ch AS (
  SELECT *, close - prior AS change, ln(close / prior) AS ret,
         CASE WHEN prior IS NULL THEN high - low ELSE greatest(high - low, abs(high - prior), abs(low - prior)) END AS true_range
  FROM moved)"""
)
_PLANS = (
    _BARS
    + """, plans AS (
  SELECT symbol || '/' || open_ms AS plan_id, symbol, close_ms AS at_ms, close AS entry,
         CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 'long' ELSE 'short' END AS side,
         CASE WHEN (open_ms // 3600000) % 2 = 0 THEN close * 0.9::DOUBLE ELSE close * 1.5::DOUBLE END AS stop,
         CASE WHEN (open_ms // 3600000) % 2 = 0 THEN close * 1.5::DOUBLE ELSE close * 0.9::DOUBLE END AS target
  FROM bars), path AS (
  SELECT p.*, b.close_ms, b.high, b.low, b.close AS bar_close,
         CASE WHEN side = 'long' THEN b.low <= stop ELSE b.high >= stop END AS at_stop,
         CASE WHEN side = 'long' THEN b.high >= target ELSE b.low <= target END AS at_target
  FROM plans p JOIN bars b ON p.symbol = b.symbol AND b.close_ms > p.at_ms AND b.close_ms <= p.at_ms + 86400000)"""
)
_TOUCH = (
    _PLANS
    + """, seen AS (
  SELECT plan_id, min(close_ms) FILTER (at_stop OR at_target) AS touch_ms, count(*) AS n_bars, max(high) AS top, min(low) AS bottom,
         arg_max(bar_close, close_ms) AS last_close,
         arg_min(CASE WHEN at_stop AND at_target THEN 'ambiguous' WHEN at_stop THEN 'stop_loss' ELSE 'take_profit' END, close_ms)
           FILTER (at_stop OR at_target) AS label
  FROM path GROUP BY plan_id
), touched AS (
  SELECT p.*, s.touch_ms, coalesce(n_bars, 0) AS n_bars, last_close, top, bottom,
         CASE WHEN n_bars IS NULL THEN 'unresolved' ELSE coalesce(label, 'expiry') END AS label
  FROM plans p LEFT JOIN seen s USING (plan_id))"""
)
_OPS = """ops AS (
  SELECT o_orderkey AS operation_id, o_custkey AS user_id, o_orderpriority AS symbol,
         CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side, CAST(o_orderkey % 50 + 100 AS DOUBLE) AS entry,
         CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(o_orderkey % 5 * 50 + 100 AS DOUBLE) END AS margin,
         CAST(o_orderkey % 10 + 1 AS DOUBLE) AS leverage,
         CAST(o_orderkey % 50 + 100 AS DOUBLE)
           + CASE WHEN (o_orderkey % 2 = 0) <> (o_orderkey % 11 = 0) THEN -5 ELSE 5 END AS stop_loss,
         CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_totalprice - 250000) / 1000 END AS final_pnl,
         ['take_profit', 'stop_loss', 'manual', 'time_expired', 'contest_expired', 'other_reason'][o_orderkey % 6 + 1] AS close_reason,
         ['plan_success', 'plan_failure', 'ambiguous_same_candle', 'expired_mark_to_market', 'unresolved', 'none'][o_orderkey % 6 + 1] AS plan_result,
         CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'PENDING_ENTRY' END AS status, o_orderdate AS closed_at,
         ['lev' || o_orderkey % 4, 'day' || o_orderkey % 7, 'lev' || o_orderkey % 3] AS signals
  FROM orders)"""
_ECON = (
    _OPS
    + """, tested AS (
  SELECT *, CASE WHEN side = 'long' THEN (entry - stop_loss) / entry ELSE (stop_loss - entry) / entry END AS risk,
         CASE close_reason WHEN 'take_profit' THEN 'automatic_take_profit' WHEN 'stop_loss' THEN 'automatic_stop_loss' WHEN 'manual' THEN 'manual'
              WHEN 'time_expired' THEN 'time_expired' WHEN 'contest_expired' THEN 'contest_expired' ELSE 'other' END AS closure,
         CASE plan_result WHEN 'plan_success' THEN 'take_profit' WHEN 'plan_failure' THEN 'stop_loss' WHEN 'ambiguous_same_candle' THEN 'ambiguous'
              WHEN 'expired_mark_to_market' THEN 'mark_to_market' WHEN 'unresolved' THEN 'unresolved' ELSE 'not_available' END AS outcome
  FROM ops
), judged AS (
  SELECT *, CASE WHEN margin <= 0 THEN 'invalid_margin' WHEN final_pnl IS NULL THEN 'missing_final_pnl'
                 WHEN risk <= 0 THEN 'stop_not_adverse_to_' || side END AS reason FROM tested
), econ AS (
  SELECT operation_id, user_id, symbol, side, closed_at, signals, reason, closure, outcome, final_pnl,
         CASE WHEN reason IS NULL THEN 'included' ELSE 'excluded' END AS status,
         CASE WHEN reason IS NULL THEN margin * leverage END AS notional, CASE WHEN reason IS NULL THEN risk END AS risk,
         CASE WHEN reason IS NULL THEN margin END AS margin FROM judged)"""
)


# ---- bars


@query(f"WITH {_BARS} SELECT symbol, open_ms, open, high, low, close, volume, round(quote_volume, 6) AS quote_volume, round(taker_buy_quote, 6) AS taker_buy_quote, n_trades, close_ms FROM bars")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(hourly(spark, sf_dir))


@query(
    f"""WITH {_BARS}
SELECT symbol, open_ms - open_ms % 14400000 AS open_ms, arg_min(open, open_ms) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, open_ms) AS close, sum(volume) AS volume, round(sum(quote_volume), 6) AS quote_volume, open_ms - open_ms % 14400000 + 14399999 AS close_ms
FROM bars GROUP BY symbol, open_ms - open_ms % 14400000 HAVING count(*) = 4"""
)
def bars_complete_4h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.rollup_bars(hourly(spark, sf_dir), HOUR, 4 * HOUR))


@query(
    f"""WITH {_BARS}, gaps AS (SELECT *, open_ms - lag(open_ms) OVER (PARTITION BY symbol ORDER BY open_ms) AS gap FROM bars)
SELECT symbol, count(*) AS n_bars, count(*) FILTER (gap = 0) AS n_repeated, count(*) FILTER (gap > 3600000) AS n_gaps,
       count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close) OR low <= 0) AS n_incoherent, max(close_ms) AS last_close_ms,
       count(*) FILTER (gap = 0 OR gap > 3600000) = 0 AS usable FROM gaps GROUP BY symbol"""
)
def bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.quality_report(hourly(spark, sf_dir), HOUR)


@query(f"WITH {_TRADES} SELECT symbol, arg_max(price, ts_ms * 1000000 + trade_id) AS price, max(ts_ms) AS ts_ms FROM trades GROUP BY symbol")
def latest_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.latest_by(trades(spark, sf_dir), ["symbol"], F.struct("ts_ms", "trade_id"), "price", "ts_ms")


@query(
    f"""WITH {_TRADES}, flow AS (
  SELECT symbol, ts_ms - ts_ms % 86400000 AS day_ms, count(*) AS n_trades, sum(CASE WHEN NOT maker THEN price * qty ELSE 0 END) AS buy,
         sum(CASE WHEN maker THEN price * qty ELSE 0 END) AS sell FROM trades GROUP BY ALL)
SELECT symbol, day_ms, n_trades, round(buy, 6) AS buy, round(sell, 6) AS sell, round(buy - sell, 6) AS delta,
       round(CASE WHEN buy + sell > 0 THEN buy / (buy + sell) ELSE 0 END, 6) AS buy_ratio FROM flow"""
)
def trade_flow_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = trades(spark, sf_dir).withColumn("day_ms", scalars.bucket_start(F.col("ts_ms"), DAY))
    return rounded(B.trade_flow(days, ["symbol", "day_ms"]))


@query(
    f"""WITH {_TRADES}, spans AS (SELECT user_id, ts_ms AS from_ms, ts_ms + 60000 * (trade_id % 600) AS to_ms FROM trades), prev AS (
  SELECT *, max(to_ms) OVER (PARTITION BY user_id ORDER BY from_ms, to_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM spans), numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR from_ms > before + 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY from_ms, to_ms ROWS UNBOUNDED PRECEDING) AS island FROM prev)
SELECT user_id, min(from_ms) AS from_ms, max(to_ms) AS to_ms, count(*) AS n FROM numbered GROUP BY user_id, island"""
)
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = trades(spark, sf_dir).select("user_id", F.col("ts_ms").alias("from_ms"), (F.col("ts_ms") + 60_000 * (F.col("trade_id") % 600)).alias("to_ms"))
    return B.merge_ranges(spans, ["user_id"], "from_ms", "to_ms", 60_000)


@query(
    f"""WITH {_BARS}, w AS (SELECT unnest(['1h', '24h', '7d']) AS "window", unnest([3600000, 86400000, 604800000]) AS ms), moved AS (
  SELECT a.open_ms, "window", CASE WHEN b.close = 0 THEN 0 ELSE (a.close - b.close) / b.close * 100 END AS x FROM bars a, w JOIN bars b ON b.symbol = a.symbol AND b.open_ms = a.open_ms - w.ms)
SELECT open_ms, "window", count(*) AS n, round(count(*) FILTER (x > 0) / count(*) * 100, 6) AS advancers_pct, round(median(x), 6) AS median_change_pct,
       round(count(*) FILTER (abs(x) >= 5) / count(*) * 100, 6) AS strong_pct FROM moved GROUP BY open_ms, "window\""""
)
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.market_breadth(hourly(spark, sf_dir), {"1h": HOUR, "24h": DAY, "7d": 7 * DAY}))


@query(
    """WITH s AS (SELECT l_orderkey AS book_id, sum(CASE WHEN l_linenumber % 2 = 1 THEN p * l_quantity ELSE 0 END) AS bid_notional, sum(CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE p * l_quantity END) AS ask_notional,
       coalesce(max(p) FILTER (l_linenumber % 2 = 1), 0) AS best_bid, coalesce(min(p) FILTER (l_linenumber % 2 = 0), 0) AS best_ask FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY l_orderkey)
SELECT book_id, round(bid_notional, 6) AS bid_notional, round(ask_notional, 6) AS ask_notional, round(best_bid + 1e-9::DOUBLE, 6) AS best_bid, round(best_ask + 1e-9::DOUBLE, 6) AS best_ask,
       round(CASE WHEN bid_notional + ask_notional <> 0 THEN (bid_notional - ask_notional) / (bid_notional + ask_notional) ELSE 0 END, 6) AS imbalance,
       round(CASE WHEN best_bid <> 0 AND best_ask <> 0 THEN (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 100 ELSE 0 END, 6) AS spread_pct FROM s"""
)
def book_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as a book: odd lines bid, even lines ask."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = B.book_summary(lines.select(F.col("l_orderkey").alias("book_id"), (F.col("l_linenumber") % 2 == 1).alias("bid"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty")), "book_id")
    # a nudge keeps quotients that end in 5 from rounding either way
    return rounded(out.withColumns({c: F.col(c) + 1e-9 for c in ("best_bid", "best_ask")}))


# ---- indicators


@query(
    f"""WITH {_CHANGES}, f AS (
  SELECT *, avg(greatest(change, 0)) OVER w14 AS gain, avg(greatest(-change, 0)) OVER w14 AS loss, avg(true_range) OVER w14 AS tr14,
         max(high) OVER w24 AS sh, min(low) OVER w24 AS sl, avg(volume) OVER w20 AS v20, avg(close) OVER w20 AS c20, stddev_pop(close) OVER w20 AS s20
  FROM ch WINDOW w14 AS (PARTITION BY symbol ORDER BY open_ms ROWS 13 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY open_ms ROWS 19 PRECEDING),
                 w24 AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING))
SELECT symbol, open_ms, close, round(CASE WHEN n <= 14 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi,
       round(CASE WHEN n > 14 THEN tr14 END, 6) AS atr, sh AS span_high, sl AS span_low,
       round(CASE WHEN sh > sl THEN (close - sl) / (sh - sl) ELSE 0.5 END, 6) AS span_place, round(volume / v20, 6) AS volume_ratio,
       round(CASE WHEN n >= 20 THEN 4 * s20 / c20 END, 6) AS bollinger_width FROM f"""
)
def indicators_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.simple_indicators(hourly(spark, sf_dir)))


@query(
    f"""WITH {_CHANGES}, a AS (
  SELECT symbol, open_ms, n, list(close) OVER w AS c, list(change) OVER w AS d, list(true_range) OVER w AS r
  FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS 59 PRECEDING)), k AS (SELECT * FROM a WHERE n > 60), s AS (
  SELECT symbol, open_ms, c, list_reduce(c, lambda x, y: x + 0.2::DOUBLE * (y - x)) AS ema_9,
         list_reduce(c, lambda x, y: x + (2.0::DOUBLE / 22) * (y - x)) AS ema_21,
         list_reduce(list_concat([list_avg(c[1:50])], c[51:]), lambda x, y: x + (2.0::DOUBLE / 51) * (y - x)) AS seeded,
         list_reduce(list_concat([list_avg(list_transform(d[1:14], lambda x: greatest(x, 0)))], list_transform(d[15:], lambda x: greatest(x, 0))), lambda x, y: (x * 13 + y) / 14) AS up,
         list_reduce(list_concat([list_avg(list_transform(d[1:14], lambda x: greatest(-x, 0)))], list_transform(d[15:], lambda x: greatest(-x, 0))), lambda x, y: (x * 13 + y) / 14) AS down,
         list_reduce(list_concat([list_avg(r[1:14])], r[15:]), lambda x, y: (x * 13 + y) / 14) AS atr FROM k)
SELECT symbol, open_ms, round(ema_9, 6) AS ema_9, round(ema_21, 6) AS ema_21, round(seeded, 6) AS seeded_ema_50,
       round(CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) AS wilder_rsi, round(atr, 6) AS wilder_atr FROM s"""
)
def indicators_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.recursive_indicators(hourly(spark, sf_dir)))


_PATH = (
    _CHANGES
    + """, pf AS (
  SELECT symbol, open_ms, n, sum(ret * ret) OVER w AS rv, sum(ret) OVER w AS disp, sum(abs(ret)) OVER w AS var, sum(volume) OVER w AS hv
  FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING)), feats AS (SELECT * FROM pf WHERE n > 24)"""
)


@query(f"WITH {_PATH} SELECT symbol, open_ms, n, round(rv, 6) AS realised_variance, round(disp, 6) AS displacement, round(var, 6) AS variation, round(CASE WHEN var > 0 THEN disp / var END, 6) AS efficiency, hv AS horizon_volume FROM feats")
def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.path_features(hourly(spark, sf_dir))
    return rounded(df).withColumn("n", F.col("n").cast("long"))


@query(
    f"""WITH {_PATH}, r AS (
  SELECT symbol, open_ms, hv, list(hv) OVER (PARTITION BY symbol, n % 24 ORDER BY open_ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ref FROM feats), m AS (
  SELECT symbol, open_ms, hv, ref, list_median(ref) AS median FROM r WHERE len(ref) = 10), d AS (
  SELECT *, list_median(list_transform(ref, lambda x: abs(x - median))) AS mad FROM m)
SELECT symbol, open_ms, hv AS value, (len(list_filter(ref, lambda x: x < hv)) + 0.5 * len(list_filter(ref, lambda x: x = hv)))::DOUBLE / 10 AS midrank, median, mad,
       round(CASE WHEN mad > 0 THEN (hv - median) / (1.4826::DOUBLE * mad) END, 6) AS robust_z FROM d"""
)
def volume_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.prior_rank(I.path_features(hourly(spark, sf_dir)), "horizon_volume", 24, 10))


@query(
    f"""WITH {_BARS}, l AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY open_ms DESC) AS r, open_ms FROM bars), v AS (
  SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY open_ms) AS i FROM l WHERE r <= 48)
SELECT a.symbol, any_value((SELECT count(*) FROM v x WHERE x.symbol = a.symbol))::INT AS n, round(median((b.close - a.close) / (b.i - a.i)), 6) AS slope
FROM v a JOIN v b ON a.symbol = b.symbol AND a.i < b.i GROUP BY a.symbol"""
)
def theil_sen_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(I.theil_sen(hourly(spark, sf_dir), ["symbol"], "open_ms", "close", 48))


# ---- levels

_PIVOTS = (
    _BARS
    + """, around AS (
  SELECT symbol, open_ms, high, low, row_number() OVER (PARTITION BY symbol ORDER BY open_ms) AS n, list(high) OVER w AS h, list(low) OVER w AS l
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), pivots AS (
  SELECT symbol, open_ms, n, 'high' AS kind, high AS price FROM around WHERE len(h) = 7 AND list_max(h) = high AND len(list_filter(h, lambda x: x = high)) = 1
  UNION ALL
  SELECT symbol, open_ms, n, 'low', low FROM around WHERE len(h) = 7 AND list_min(l) = low AND len(list_filter(l, lambda x: x = low)) = 1)"""
)
_LEGS = (
    _PIVOTS
    + """, marks AS (SELECT *, CASE WHEN lag(kind) OVER t IS DISTINCT FROM kind THEN 1 ELSE 0 END AS fresh FROM pivots WINDOW t AS (PARTITION BY symbol ORDER BY open_ms, kind)), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY open_ms, kind ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marks), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY CASE WHEN kind = 'high' THEN price ELSE -price END DESC, open_ms) AS r FROM runs), legs AS (
  SELECT symbol, run, kind, open_ms, price FROM ranked WHERE r = 1)"""
)
_FIB = (
    _LEGS
    + """, pairs AS (SELECT symbol, run, lag(price) OVER (PARTITION BY symbol ORDER BY run) AS s, price AS e FROM legs), leg AS (
  SELECT symbol, arg_max(s, run) AS s, arg_max(e, run) AS e FROM pairs WHERE s IS NOT NULL GROUP BY symbol), fib AS (
  SELECT symbol, 'retracement' AS kind, ratio, e - ratio * (e - s) AS level FROM leg, (SELECT unnest([0.236, 0.382, 0.5, 0.618, 0.786]::DOUBLE[]) AS ratio)
  UNION ALL SELECT symbol, 'extension', ratio, s + ratio * (e - s) FROM leg, (SELECT unnest([1.272, 1.618, 2.0]::DOUBLE[]) AS ratio))"""
)


@query(f"WITH {_PIVOTS} SELECT * FROM pivots")
def price_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.pivots(hourly(spark, sf_dir)).withColumn("n", F.col("n").cast("long"))


@query(f"WITH {_LEGS} SELECT * FROM legs")
def alternating_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return levels.alternating(levels.pivots(hourly(spark, sf_dir)))


@query(f"WITH {_FIB} SELECT symbol, kind, ratio, round(level, 6) AS level FROM fib")
def fibonacci_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(levels.fibonacci(levels.alternating(levels.pivots(hourly(spark, sf_dir)))))


@query(
    f"""WITH {_FIB}, px AS (SELECT symbol, arg_max(close, open_ms) AS price FROM bars GROUP BY symbol), r AS (
  SELECT fib.*, price, row_number() OVER (PARTITION BY symbol ORDER BY abs(ln(level / price)), kind, ratio) AS r FROM fib JOIN px USING (symbol) WHERE level > 0)
SELECT symbol, price, kind, ratio, round(level, 6) AS level FROM r WHERE r = 1"""
)
def nearest_fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = hourly(spark, sf_dir)
    prices = bars.groupBy("symbol").agg(F.max_by("close", "open_ms").alias("price"))
    return rounded(levels.nearest_level(levels.fibonacci(levels.alternating(levels.pivots(bars))), prices))


@query(
    """WITH lines AS (SELECT l_orderkey AS book_id, l_extendedprice / l_quantity AS price, l_quantity AS qty,
       coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice / l_quantity, l_quantity, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lineitem), takes AS (
  SELECT book_id, price, greatest(0, least(qty, 60 - before)) AS took FROM lines)
SELECT book_id, round(sum(took), 6) AS filled, round(CASE WHEN sum(took) > 0 THEN sum(took * price) / sum(took) END + 1e-9::DOUBLE, 6) AS vwap, round(sum(took) / 60, 6) AS fill_ratio FROM takes GROUP BY book_id"""
)
def depth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market order of 60 through each order's lines, taken as the levels of a book."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("book_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("qty"), "l_linenumber")
    books = lines.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("price", "qty", "l_linenumber"))).alias("asks"))
    return rounded(books.select("book_id", levels.book_walk(F.col("asks"), F.lit(60.0)).alias("w")).select("book_id", "w.filled", (F.col("w.vwap") + 1e-9).alias("vwap"), "w.fill_ratio"))


# ---- joins on time


@query(
    """WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT p.event_id, p.user_id, arg_max(v.event_id, v.event_id) AS seen_id, arg_max(v.value, v.event_id) AS seen_value
FROM p LEFT JOIN v ON p.user_id = v.user_id AND v.ts <= p.ts GROUP BY p.event_id, p.user_id"""
)
def asof_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's latest view at or before it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.struct(F.col("event_id").alias("seen_id"), F.col("value").alias("seen_value")).alias("seen"))
    return joins.asof_backward(left, right, ["user_id"], "ts", "seen").select("event_id", "user_id", "seen.seen_id", "seen.seen_value")


@query(
    f"""WITH {_PATH}, days AS (SELECT symbol || '/' || open_ms AS row_id, symbol, open_ms, disp, rv, ln(1 + hv) AS lv, n FROM feats), d AS (
  SELECT q.row_id AS query_id, r.row_id, sqrt(((q.disp - r.disp) ** 2 + (q.rv - r.rv) ** 2 + (q.lv - r.lv) ** 2) / 3) + CASE WHEN q.symbol = r.symbol THEN 0 ELSE 0.15::DOUBLE END AS dist
  FROM days q JOIN days r ON q.n % 24 = 0 AND r.open_ms < q.open_ms), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id)::INT AS rank FROM d)
SELECT query_id, rank, row_id, round(dist, 6) AS dist FROM k WHERE rank <= 5"""
)
def nearest_analogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all earlier bars by path features, of every 24th bar (the stated query set); other symbols at a penalty."""
    v = F.array("displacement", "realised_variance", F.ln(1 + F.col("horizon_volume"))).alias("v")
    days = stored(I.path_features(hourly(spark, sf_dir)).select("n", F.concat_ws("/", "symbol", F.col("open_ms").cast("string")).alias("row_id"), "symbol", F.col("open_ms").alias("at_ms"), v), "days")
    tree = analogs.Boxes(days, 3)
    return rounded(tree.nearest(days.where("n % 24 = 0").withColumnRenamed("row_id", "query_id"), 5, 0.15))


# ---- outcomes


@query(
    f"""WITH {_TOUCH} SELECT plan_id, label, touch_ms, n_bars,
  round(greatest(CASE WHEN side = 'long' THEN top / entry - 1 ELSE 1 - bottom / entry END * 100, CASE WHEN top IS NULL THEN NULL ELSE 0 END), 6) AS mfe,
  round(least(CASE WHEN side = 'long' THEN bottom / entry - 1 ELSE 1 - top / entry END * 100, CASE WHEN top IS NULL THEN NULL ELSE 0 END), 6) AS mae, last_close FROM touched"""
)
def first_touch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored(hourly(spark, sf_dir), "bars")
    df = outcomes.first_touch(plans_of(bars), bars, DAY)
    return rounded(df).withColumns({c: F.when(F.col("n_bars") > 0, F.col(c)) for c in ("mfe", "mae")})


@query(
    f"""WITH {_TOUCH} SELECT plan_id, """
    + ", ".join(f"CASE WHEN touch_ms <= at_ms + {h} * 3600000 THEN label WHEN label = 'unresolved' THEN label ELSE 'expiry' END AS label_{h}h" for h in (4, 12, 24))
    + " FROM touched"
)
def nested_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored(hourly(spark, sf_dir), "bars")
    return outcomes.nested_labels(plans_of(bars), bars, [4 * HOUR, 12 * HOUR, 24 * HOUR])


@query(
    f"""WITH {_PLANS}, steps AS (SELECT plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY close_ms)::INT AS step, ln(high / entry) AS up, ln(entry / low) AS down FROM path), m AS (
  SELECT plan_id, step, 'up' AS direction, up AS move FROM steps UNION ALL SELECT plan_id, step, 'down', down FROM steps), t AS (
  SELECT *, coalesce(max(move) OVER (PARTITION BY plan_id, direction ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM m)
SELECT plan_id, direction, step, round(move, 6) AS level FROM t WHERE move > top"""
)
def excursion_frontiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = stored(hourly(spark, sf_dir), "bars")
    return rounded(outcomes.frontiers(plans_of(bars), bars, DAY))


# ---- reports


@query(
    f"""WITH {_ECON} SELECT operation_id, status, reason, closure, outcome, """
    + ", ".join(f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), 8) AS DOUBLE) AS {n}" for x, n in (("notional", "notional"), ("risk * 100", "risk_pct"), ("notional * risk", "risk_amount"), ("final_pnl / notional * 100", "return_pct"), ("final_pnl / margin * 100", "margin_return_pct"), ("final_pnl / (notional * risk)", "r_multiple")))
    + " FROM econ"
)
def economics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.normalised_economics(operations(spark, sf_dir))


@query(
    f"""WITH {_ECON} SELECT closure AS name, count(*) AS n, count(*) FILTER (status = 'included') AS n_included, round(avg(final_pnl / (notional * risk)), 6) AS avg_r,
  round(median(final_pnl / (notional * risk)), 6) AS median_r, round(sum(final_pnl / margin * 100), 4) AS sum_margin_return, count(*) FILTER (outcome = 'take_profit') AS n_take_profit
FROM econ GROUP BY closure"""
)
def economics_by_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reports.grouped_cases(reports.normalised_economics(operations(spark, sf_dir)), "closure")
    return rounded(df, but=("sum_margin_return",)).withColumn("sum_margin_return", F.round("sum_margin_return", 4))


@query(
    f"""WITH {_OPS}, run AS (SELECT user_id, sum(final_pnl) OVER t AS s, operation_id, closed_at, final_pnl FROM ops WHERE final_pnl IS NOT NULL
  WINDOW t AS (PARTITION BY user_id ORDER BY closed_at, operation_id ROWS UNBOUNDED PRECEDING)), peak AS (
  SELECT *, greatest(0, max(s) OVER (PARTITION BY user_id ORDER BY closed_at, operation_id ROWS UNBOUNDED PRECEDING)) - s AS fall FROM run)
SELECT user_id, round(max(fall), 5) AS max_drawdown, round(sum(final_pnl), 5) AS total, count(*) AS n FROM peak GROUP BY user_id"""
)
def drawdown_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reports.max_drawdown(operations(spark, sf_dir).where("final_pnl is not null"), ["user_id"], ["closed_at", "operation_id"], "final_pnl"), 5)


_SIGNALS = _OPS + ", cases AS (SELECT operation_id AS case_id, coalesce(final_pnl > 0, false) AS ok, list_sort(list_distinct(signals)) AS s FROM ops)"


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    return operations(spark, sf_dir).withColumnRenamed("operation_id", "case_id"), F.coalesce(F.col("final_pnl") > 0, F.lit(False))


@query(f"WITH {_SIGNALS} SELECT signal, count(*) AS n, round(avg(ok::INT), 6) AS rate, min(case_id) AS first_case FROM (SELECT case_id, ok, unnest(s) AS signal FROM cases) GROUP BY signal HAVING count(*) >= 5")
def signal_effectiveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, ok = _cases(spark, sf_dir)
    return rounded(reports.signal_effectiveness(cases, "signals", ok, 5))


@query(f"WITH {_SIGNALS}, e AS (SELECT case_id, ok, unnest(s) AS sig FROM cases) SELECT x.sig AS a, y.sig AS b, count(*) AS n, round(avg(x.ok::INT), 6) AS rate FROM e x JOIN e y ON x.case_id = y.case_id AND x.sig < y.sig GROUP BY 1, 2")
def signal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, ok = _cases(spark, sf_dir)
    return rounded(reports.signal_pairs(cases, "signals", ok))


@query(
    f"""WITH {_OPS}, px AS (SELECT symbol, arg_max(entry, operation_id) AS price FROM ops WHERE symbol <> '5-LOW' GROUP BY symbol), m AS (
  SELECT user_id, sum(CASE WHEN status = 'CLOSED' THEN coalesce(final_pnl, 0) ELSE 0 END) AS realised,
         sum(CASE WHEN status = 'OPEN' AND price IS NOT NULL THEN (CASE WHEN side = 'long' THEN 1 ELSE -1 END) * margin * leverage * (price / entry - 1) ELSE 0 END) AS unrealised,
         count(*) FILTER (status = 'CLOSED') AS n_closed, count(*) FILTER (status = 'OPEN') AS n_open,
         count(*) FILTER (status = 'CLOSED' AND final_pnl > 0) AS wins, count(*) FILTER (status = 'CLOSED' AND final_pnl < 0) AS losses, sum(CASE WHEN status = 'OPEN' THEN margin ELSE 0 END) AS invested FROM ops LEFT JOIN px USING (symbol) GROUP BY user_id), b AS (
  SELECT c_custkey AS user_id, coalesce(realised, 0) AS realised, coalesce(unrealised, 0) AS unrealised, coalesce(n_closed, 0) AS n_closed, coalesce(n_open, 0) AS n_open, coalesce(wins, 0) AS wins, coalesce(losses, 0) AS losses, coalesce(invested, 0)::DOUBLE AS invested FROM customer LEFT JOIN m ON c_custkey = m.user_id)
SELECT user_id, round(realised, 5) AS realised, round(unrealised + 1e-9::DOUBLE, 5) AS unrealised, n_closed, n_open, wins, losses, invested, round(10000 + realised + unrealised + 1e-9::DOUBLE, 5) AS equity FROM b"""
)
def contest_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    prices = ops.where("symbol <> '5-LOW'").groupBy("symbol").agg(F.max_by("entry", "operation_id").alias("price"))
    rows = ops.withColumn("notional", F.col("margin") * F.col("leverage")).withColumn("pnl", F.coalesce("final_pnl", F.lit(0.0)))
    entries = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    board = reports.leaderboard(entries, rows, prices, 10_000.0)
    # a nudge keeps sums that end in 5 from rounding either way
    return rounded(board.withColumn("unrealised", F.col("unrealised") + 1e-9).withColumn("equity", F.col("equity") + 1e-9), 5)


@query(
    """WITH last AS (SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id)
SELECT c_custkey, event_id, event_type, value FROM customer LEFT JOIN last ON c_custkey = user_id"""
)
def latest_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with the latest event of their id."""
    left = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("user_id"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    return reports.latest_joined(left, events, "user_id", F.col("event_id"), ["event_id", "event_type", "value"]).withColumnRenamed("user_id", "c_custkey")


@query(
    f"""WITH {_OPS}, both_ AS (SELECT operation_id, status, leverage, 1 AS v, 0 AS new FROM ops WHERE operation_id % 3 <> 0
  UNION ALL SELECT operation_id, 'CLOSED', leverage + 1, operation_id % 2 + 1, 1 FROM ops WHERE operation_id % 5 = 0)
SELECT operation_id, arg_max(status, v * 2 + new) AS status, arg_max(leverage, v * 2 + new) AS leverage, CAST(max(v) AS BIGINT) AS version FROM both_ GROUP BY operation_id"""
)
def versioned_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = operations(spark, sf_dir)
    current = ops.where("operation_id % 3 <> 0").select("operation_id", "status", "leverage", F.lit(1).cast("long").alias("version"))
    changes = ops.where("operation_id % 5 = 0").select("operation_id", F.lit("CLOSED").alias("status"), (F.col("leverage") + 1).alias("leverage"), (F.col("operation_id") % 2 + 1).alias("version"))
    return reports.upsert(current, changes, ["operation_id"], "version")


@query("SELECT event_id, CAST(day AS VARCHAR) AS day, slot FROM (SELECT event_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id)::INT AS slot FROM events) WHERE slot <= 50")
def daily_snapshot_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 50 snapshots a day, in order of time: the feature is the cap."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.to_date("ts").alias("day"))
    return reports.daily_slots(events, "day", ["ts", "event_id"], 50).select("event_id", F.col("day").cast("string").alias("day"), "slot")


# ---- probabilities and statistics

_FP = (
    _PATH
    + """, bq AS (SELECT f.symbol || '/' || f.open_ms AS plan_id, sqrt(rv) AS sigma, ln(1.5) AS far, ln(1 / 0.9::DOUBLE) AS near, (f.open_ms // 3600000) % 2 = 0 AS is_long FROM feats f WHERE rv > 0), geo AS (
  SELECT plan_id, sigma, CASE WHEN is_long THEN far ELSE ln(1 / 0.9::DOUBLE) END AS a, CASE WHEN is_long THEN near ELSE ln(1.5) END AS b FROM bq), ser AS (
  SELECT *, pi() * pi() / 2 * sigma * sigma / ((a + b) * (a + b)) AS decay, greatest(8, ceil(sqrt(31.0 / (pi() * pi() / 2 * sigma * sigma / ((a + b) * (a + b))))))::INT AS terms FROM geo), fp AS (
  SELECT plan_id, least(1, greatest(0, b / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END * sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_tp,
         least(1, greatest(0, a / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_sl FROM ser), probs AS (
  SELECT plan_id, p_tp, p_sl, least(1, greatest(0, 1 - p_tp - p_sl)) AS p_expiry FROM fp)"""
)


PATH_FEATURES = ("realised_variance", "displacement", "variation", "efficiency", "horizon_volume")


def moved_plans(bars: DataFrame) -> DataFrame:
    """Plans of bars whose last day has moved, with the day's path features and sigma: one window over the bars, no join."""
    moved = I.path_features(bars, keep=("close", "close_ms")).where("realised_variance > 0")
    return plans_of(moved, PATH_FEATURES).withColumn("sigma", F.sqrt("realised_variance"))


def with_first_passage(plans: DataFrame) -> DataFrame:
    """plans (with sigma) and the barriers' log distances up and down, p_tp, p_sl, p_expiry."""
    up, down = scalars.log_distances(F.col("side"), F.col("entry"), F.col("stop"), F.col("target"))
    known = plans.withColumn("up", up).withColumn("down", down)
    return known.withColumn("_p", probability.double_barrier(F.col("up"), F.col("down"), F.col("sigma"))).select("*", "_p.*").drop("_p")


def first_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, symbol, at_ms, p_tp, p_sl, p_expiry of every plan whose last day has moved."""
    return with_first_passage(moved_plans(hourly(spark, sf_dir))).select("plan_id", "symbol", "at_ms", "side", "sigma", "p_tp", "p_sl", "p_expiry")


@query(f"WITH {_FP} SELECT plan_id, round(p_tp, 6) AS p_tp, round(p_sl, 6) AS p_sl, round(p_expiry, 6) AS p_expiry FROM probs")
def first_passage_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(first_passage(spark, sf_dir).select("plan_id", "p_tp", "p_sl", "p_expiry"))


_RISKS = (
    _FP
    + """, grid AS (SELECT plan_id, i, a, b, pi() * pi() / 2 * sigma * sigma * i / 24 / ((a + b) * (a + b)) AS decay FROM geo, (SELECT unnest(range(1, 25)) AS i)), pts AS (
  SELECT plan_id, i, least(1, greatest(0, b / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END * sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_tp,
         least(1, greatest(0, a / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_sl FROM (SELECT *, greatest(8, ceil(sqrt(31.0 / decay)))::INT AS terms FROM grid)), seq AS (
  SELECT *, coalesce(lag(p_tp) OVER t, 0) AS q_tp, coalesce(lag(p_sl) OVER t, 0) AS q_sl, CASE WHEN i = 1 THEN 1 ELSE greatest(0, 1 - lag(p_tp) OVER t - lag(p_sl) OVER t) END AS q FROM pts WINDOW t AS (PARTITION BY plan_id ORDER BY i)), hz AS (
  SELECT plan_id, i, CASE WHEN q > 1e-10 THEN (p_tp - q_tp) / q ELSE 0 END AS tp, CASE WHEN q > 1e-10 THEN (p_sl - q_sl) / q ELSE 0 END AS sl FROM seq), wt AS (
  SELECT plan_id, i, greatest(tp, 0) * exp(0.2::DOUBLE) AS w1, greatest(sl, 0) * exp(-0.1::DOUBLE) AS w2, greatest(1 - tp - sl, 0) AS w3 FROM hz), alive AS (
  SELECT *, coalesce(product(w3 / (w1 + w2 + w3)) OVER (PARTITION BY plan_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS left_ FROM wt)"""
)


@query(f"WITH {_RISKS} SELECT plan_id, round(sum(left_ * w1 / (w1 + w2 + w3)), 6) AS p_tp, round(sum(left_ * w2 / (w1 + w2 + w3)), 6) AS p_sl, round(product(w3 / (w1 + w2 + w3)), 6) AS p_expiry FROM alive GROUP BY plan_id")
def competing_risk_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-passage curves of every plan in 24 intervals, moved by a little evidence for the target."""
    rows = first_passage(spark, sf_dir).select("plan_id", "side", "sigma")
    up = F.when(F.col("side") == "long", F.ln(F.lit(1.5))).otherwise(-F.ln(F.lit(0.9)))
    down = F.when(F.col("side") == "long", -F.ln(F.lit(0.9))).otherwise(F.ln(F.lit(1.5)))
    return rounded(rows.select("plan_id", probability.competing_risks(up, down, F.col("sigma"), F.lit(0.2), F.lit(-0.1)).alias("p")).select("plan_id", "p.*"))


_EVAL = (
    _FP
    + """, pl AS (SELECT symbol || '/' || open_ms AS plan_id, symbol, close_ms AS at_ms, close AS entry, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 'long' ELSE 'short' END AS side,
         CASE WHEN (open_ms // 3600000) % 2 = 0 THEN close * 0.9::DOUBLE ELSE close * 1.5::DOUBLE END AS stop, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN close * 1.5::DOUBLE ELSE close * 0.9::DOUBLE END AS target FROM bars), hits AS (
  SELECT p.plan_id, b.close_ms, CASE WHEN side = 'long' THEN b.low <= stop ELSE b.high >= stop END AS s, CASE WHEN side = 'long' THEN b.high >= target ELSE b.low <= target END AS t
  FROM pl p JOIN bars b ON p.symbol = b.symbol AND b.close_ms > p.at_ms AND b.close_ms <= p.at_ms + 86400000), lab AS (
  SELECT plan_id, coalesce(arg_min(CASE WHEN s AND t THEN 'ambiguous' WHEN s THEN 'stop_loss' ELSE 'take_profit' END, close_ms) FILTER (s OR t), 'expiry') AS label FROM hits GROUP BY plan_id), ev AS (
  SELECT probs.*, label, side, symbol FROM probs JOIN lab USING (plan_id) JOIN pl USING (plan_id) WHERE label <> 'ambiguous'), scored AS (
  SELECT *, (p_tp - (label = 'take_profit')::INT) ** 2 + (p_sl - (label = 'stop_loss')::INT) ** 2 + (p_expiry - (label = 'expiry')::INT) ** 2 AS brier,
         -ln(greatest(CASE label WHEN 'take_profit' THEN p_tp WHEN 'stop_loss' THEN p_sl ELSE p_expiry END, 1e-15)) AS log_loss FROM ev)"""
)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans with first-passage probabilities, a label and losses: bars are built once, and plans carry their probabilities to the label."""
    bars = stored(hourly(spark, sf_dir), "bars")
    plans = with_first_passage(moved_plans(bars))
    out = outcomes.first_touch(plans, bars, DAY, ("symbol", "at_ms", "side", "sigma", "p_tp", "p_sl", "p_expiry"))
    return statistics.losses(out.where("label not in ('ambiguous', 'unresolved')"))


@query(f"WITH {_EVAL} SELECT symbol, side, count(*) AS n, round(avg(brier), 5) AS brier, round(avg(log_loss), 5) AS log_loss FROM scored GROUP BY GROUPING SETS ((symbol), (side), ())")
def evaluation_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    out = df.groupingSets([[F.col("symbol")], [F.col("side")], []], "symbol", "side").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"), F.avg("log_loss").alias("log_loss"))
    return rounded(out, 5)


@query(
    f"""WITH {_EVAL}, r AS (SELECT side, round(p_tp, 9) AS s, label = 'take_profit' AS pos FROM ev)
SELECT side, count(*) FILTER (pos) AS n_positive, count(*) FILTER (NOT pos) AS n_negative,
  round(CASE WHEN count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0 THEN (sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) END, 6) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY side ORDER BY s) + (count(*) OVER (PARTITION BY side, s) - 1) / 2.0::DOUBLE AS k FROM r) GROUP BY side"""
)
def auc_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).withColumn("score", F.round("p_tp", 9))
    return rounded(statistics.rank_auc(df, ["side"], "score", F.col("label") == "take_profit"))


@query(
    f"""WITH {_EVAL}, b AS (SELECT least(floor(round(p_tp, 9) * 10), 9)::INT AS bin, count(*) AS n, avg(p_tp) AS m, avg((label = 'take_profit')::INT) AS r FROM ev GROUP BY 1)
SELECT bin, n, round(m, 5) AS mean_p, round(r, 5) AS rate, round(n / sum(n) OVER () * abs(m - r), 5) AS ece_part FROM b"""
)
def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir).withColumn("p_tp", F.round("p_tp", 9))
    return rounded(statistics.calibration(df, "p_tp", F.col("label") == "take_profit"), 5)


@query(
    """WITH t AS (SELECT l_suppkey AS name, avg(l_discount) * 10 AS p FROM lineitem GROUP BY l_suppkey), r AS (
  SELECT *, row_number() OVER (ORDER BY round(p, 9), name) AS r, count(*) OVER () AS m FROM t)
SELECT name, round(round(p, 9), 6) AS p, round(min(least(1, round(p, 9) * m / r)) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS q FROM r"""
)
def bh_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("name")).agg(F.round(F.avg("l_discount") * 10, 9).alias("p"))
    return rounded(statistics.benjamini_hochberg(tests, "name", "p"))


@query(
    """WITH b AS (SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1), n AS (SELECT day, v, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS m FROM b), d AS (
  SELECT draw, ('0x' || substr(md5('7/' || draw || '/' || i), 1, 8))::BIGINT % m AS i FROM n, (SELECT unnest(range(0, 200)) AS draw))
SELECT CAST(draw AS INT) AS draw, round(avg(v), 5) AS mean FROM d JOIN n USING (i) GROUP BY draw"""
)
def bootstrap_daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return rounded(statistics.block_bootstrap(days, "day", "v", 200, 7), 5)


# ---- rules and lifecycle

RULES = ["plan_geometry", "realized_volatility", "normalized_barriers", "path_structure", "prior_extrema", "volatility_rank", "hierarchy", "regime"]


def rule_traces(spark: SparkSession, sf_dir: str, bars: DataFrame | None = None) -> DataFrame:
    bars = (hourly(spark, sf_dir) if bars is None else bars).withColumn("entry", F.col("close")).withColumn("stop", F.col("close") * 0.9).withColumn("target", F.col("close") * 1.5)
    return rules.core_rules(bars)


@query(
    f"""WITH {_CHANGES}, pf AS (SELECT symbol, open_ms, n, close, sum(ret * ret) OVER w AS v, sum(ret) OVER w AS d, sum(abs(ret)) OVER w AS p, max(high) OVER w AS top, min(low) OVER w AS bottom FROM ch
  WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING)), rr AS (
  SELECT *, len(list(CASE WHEN n > 24 THEN v END) FILTER (n > 24) OVER (PARTITION BY symbol, n % 24 ORDER BY open_ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)) AS k FROM pf)
SELECT symbol, open_ms, CASE WHEN n > 24 AND v > 0 THEN round(sqrt(v), 6) END AS sigma, CASE WHEN n > 24 AND v > 0 THEN round(ln(1.5) / sqrt(v), 6) END AS z_tp,
  CASE WHEN n > 24 AND v > 0 THEN round(d / p, 6) END AS efficiency, top, bottom, CASE WHEN n > 24 AND v > 0 AND k = 10 THEN 'evaluated' ELSE 'blocked' END AS regime_status,
  CASE WHEN NOT (n > 24 AND v > 0) THEN 'dependency_not_evaluated' WHEN coalesce(k, 0) < 10 THEN 'dependency_not_evaluated' END AS regime_reason FROM rr"""
)
def rule_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = rule_traces(spark, sf_dir)
    return rounded(df.select("symbol", "open_ms", "realized_volatility.sigma", "normalized_barriers.z_tp", "path_structure.efficiency", "prior_extrema.top", "prior_extrema.bottom", F.col("regime.status").alias("regime_status"), F.col("regime.reason").alias("regime_reason")))


_STATES = f"""WITH {_CHANGES}, pf AS (SELECT symbol, open_ms, n, sum(ret * ret) OVER w AS v, sum(abs(ret)) OVER w AS p FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING)), k AS (
  SELECT *, count(CASE WHEN n > 24 THEN v END) OVER (PARTITION BY symbol, n % 24 ORDER BY open_ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS k FROM pf), s AS (
  SELECT n > 24 AND v > 0 AS vol, n > 24 AND v > 0 AND k = 10 AS rank FROM k), r AS (
  SELECT rule, vol, rank, CASE rule WHEN 'plan_geometry' THEN 1 WHEN 'prior_extrema' THEN 1 WHEN 'realized_volatility' THEN vol::INT WHEN 'volatility_rank' THEN rank::INT WHEN 'regime' THEN rank::INT ELSE vol::INT END AS ok
  FROM s, (SELECT unnest(['plan_geometry', 'realized_volatility', 'normalized_barriers', 'path_structure', 'prior_extrema', 'volatility_rank', 'hierarchy', 'regime']) AS rule))
SELECT rule, CASE ok WHEN 1 THEN 'evaluated' ELSE 'blocked' END AS status, CASE WHEN ok = 1 THEN '-' WHEN rule = 'realized_volatility' THEN 'not_enough_bars' WHEN rule = 'volatility_rank' AND vol THEN 'reference_too_short' ELSE 'dependency_not_evaluated' END AS reason,
  count(*) AS n FROM r GROUP BY ALL"""


@query(_STATES)
def rule_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rule_counts(rule_traces(spark, sf_dir), RULES)


@query(
    f"""WITH {_OPS}, e AS (SELECT operation_id, status, ['trigger', 'expire', 'cancel', 'take_profit', 'stop_loss', 'manual'][operation_id % 6 + 1] AS event FROM ops)
SELECT operation_id, status, event, CASE WHEN status = 'PENDING_ENTRY' THEN CASE event WHEN 'trigger' THEN 'OPEN' WHEN 'expire' THEN 'EXPIRED_UNFILLED' WHEN 'cancel' THEN 'CANCELLED' END
  WHEN status = 'OPEN' AND event IN ('take_profit', 'stop_loss', 'expire', 'manual') THEN 'CLOSED' END AS target FROM e"""
)
def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = F.array(*map(F.lit, ("trigger", "expire", "cancel", "take_profit", "stop_loss", "manual")))
    ops = operations(spark, sf_dir).select("operation_id", "status", F.element_at(events, (F.col("operation_id") % 6 + 1).cast("int")).alias("event"))
    return ops.withColumn("target", scalars.transition(F.col("status"), F.col("event")))
