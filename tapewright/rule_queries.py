"""Queries of the scores and of the rules on market context and money, over hourly bars, with their SQL twins.

A case is a plan at a bar's close; its measures are taken from the bars about it, by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.catalog import _BARS, HOUR, hourly, query, rounded
from tapewright.functions import scoring as S
from tapewright.plans import market_rules as M

_W = "PARTITION BY symbol ORDER BY open_ms"
_LAST = f"OVER ({_W} ROWS BETWEEN {{}} PRECEDING AND CURRENT ROW)"
#: What a bar knows of the bars about it, in SQL that both engines read: first of the bars' own columns, then of these.
NEIGHBOURS = {
    "n": f"row_number() OVER ({_W})",
    "prev": f"lag(close) OVER ({_W})",
    "prev4": f"lag(close, 4) OVER ({_W})",
    "old": f"lag(close, 24) OVER ({_W})",
    "next_high": f"lead(high) OVER ({_W})",
    "next_low": f"lead(low) OVER ({_W})",
    "next_close": f"lead(close) OVER ({_W})",
    "hi": f"max(high) {_LAST.format(23)}",
    "lo": f"min(low) {_LAST.format(23)}",
    "mean20": f"avg(close) {_LAST.format(19)}",
    "buy": f"sum(taker_buy_quote) {_LAST.format(23)}",
    "traded": f"sum(quote_volume) {_LAST.format(23)}",
    "vol": f"sum(volume) {_LAST.format(23)}",
}
MOVES = {
    "ups": f"CAST(sum(CASE WHEN close > prev THEN 1 ELSE 0 END) {_LAST.format(23)} AS BIGINT)",
    "downs": f"CAST(sum(CASE WHEN close < prev THEN 1 ELSE 0 END) {_LAST.format(23)} AS BIGINT)",
    "gain": f"avg(greatest(close - prev, CAST(0 AS DOUBLE))) {_LAST.format(13)}",
    "loss": f"avg(greatest(prev - close, CAST(0 AS DOUBLE))) {_LAST.format(13)}",
    "span": f"avg(high - low) {_LAST.format(13)}",
    "old_vol": f"lag(vol, 24) OVER ({_W})",
    "risers": "avg(CASE WHEN close > prev THEN 100 ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY open_ms)",
    "moved": "avg((close - prev) / prev) OVER (PARTITION BY open_ms)",
    "alive": "count(*) OVER (PARTITION BY open_ms)",
}
_STACK = "CASE WHEN close > {0} * CAST(1.1 AS DOUBLE) THEN 'bullish' WHEN close < {0} * CAST(0.9 AS DOUBLE) THEN 'bearish' ELSE 'mixed' END"
_RSI_14 = "CASE WHEN n > 14 THEN CASE WHEN loss = 0 THEN CAST(100 AS DOUBLE) ELSE 100 - 100 / (1 + gain / loss) END END"
#: Columns of a case by name, from the bar whose close opens it; k is the case's key.
MEASURES = {
    "side": "CASE WHEN close >= mean20 THEN 'long' ELSE 'short' END",
    "horizon": "CASE WHEN n_trades >= 4 THEN 'intraday_short' WHEN n_trades = 3 THEN 'intraday_wide' WHEN n_trades = 2 THEN 'short_swing' ELSE 'other' END",
    "entry": "close",
    "margin": "CASE WHEN close = low AND close = high THEN CAST(0 AS DOUBLE) ELSE volume * 10 END",
    "leverage": "CAST(n_trades AS DOUBLE)",
    "reward_pct": "(hi - close) / close * 4",
    "risk_pct": "(close - lo) / close * 4 + CAST(0.2 AS DOUBLE)",
    "funding": "CASE WHEN n_trades > 1 THEN (taker_buy_quote / quote_volume - CAST(0.5 AS DOUBLE)) / 10 END",
    "funding_recent": "CASE WHEN n > 24 THEN (buy / traded - CAST(0.5 AS DOUBLE)) / 10 END",
    "taker": "CASE WHEN traded > buy THEN buy / (traded - buy) END",
    "crowd": "CASE WHEN n >= 24 THEN volume / (vol / 24) END",
    "cvd": "CASE WHEN n >= 24 THEN 2 * buy / traded - 1 END",
    "greed": _RSI_14,
    "change": "coalesce((close - prev) / prev * 10, CAST(0 AS DOUBLE))",
    "interest": "CASE WHEN old_vol > 0 THEN vol / old_vol - 1 END",
    "advancers": "CASE WHEN alive >= 3 THEN risers END",
    "median_change": "coalesce(moved, CAST(0 AS DOUBLE))",
    "range_pct": "(hi - lo) / close / 2",
    "atr": "span / close / 8",
    "barrier_pct": "CASE WHEN hi > close THEN (hi - close) / close * 3 END",
    "rsi": _RSI_14,
    "from_ema": "CASE WHEN n >= 20 THEN close / mean20 - 1 END",
    "spread": "(high - low) / close / 8",
    "tp": "CASE WHEN hi > lo THEN CAST(0.3 AS DOUBLE) + CAST(0.4 AS DOUBLE) * (close - lo) / (hi - lo) ELSE CAST(0.5 AS DOUBLE) END",
    "sl": "CASE WHEN hi > lo THEN CAST(0.6 AS DOUBLE) - CAST(0.4 AS DOUBLE) * (close - lo) / (hi - lo) ELSE CAST(0.4 AS DOUBLE) END",
    "wins": "ups",
    "losses": "downs",
    "mean_r": "CASE WHEN hi > lo THEN 2 * (close - old) / (hi - lo) END",
    "s5": _STACK.format("prev"),
    "s15": _STACK.format("prev4"),
    "s60": _STACK.format("mean20"),
    "s240": _STACK.format("old"),
    "reason": "CASE WHEN next_close IS NULL THEN 'contest_expired' WHEN next_high >= close * CAST(1.3 AS DOUBLE) THEN 'take_profit' WHEN next_low <= close * CAST(0.8 AS DOUBLE) THEN 'stop_loss' WHEN n_trades = 1 THEN 'manual' WHEN n_trades = 2 THEN 'cut_loss' WHEN close = high THEN 'emotion' ELSE 'time_expired' END",
    "observation": "CASE WHEN next_close IS NULL THEN 'plan_unresolved' WHEN next_close > close * CAST(1.2 AS DOUBLE) THEN 'manual_left_profit' WHEN next_close < close * CAST(0.85 AS DOUBLE) THEN 'manual_protected' WHEN next_close > close THEN 'manual_worse_than_plan' WHEN n_trades > 2 THEN 'manual_better_than_plan' END",
    "trigger": "CASE WHEN n_trades >= 5 THEN n_trades END",
}
#: Further columns of a case as they are, for queries that take levels and paths from them.
CARRIED = ("symbol", "open_ms", "n", "hi", "lo", "mean20", "old", "prev", "high", "low", "volume", "n_trades", "next_high", "next_low", "next_close")


def doubles(sql: str, *names: str) -> str:
    """The query with exact decimals of these names as doubles."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({n} AS DOUBLE) AS {n}' for n in names)}) FROM ({sql}) AS q"


_KEY = "CAST(floor(open_ms / 3600000) AS BIGINT) * 128 + ascii(symbol)"
_CASES = (
    _BARS
    + ", b1 AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in NEIGHBOURS.items())
    + " FROM bars), raw AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in MOVES.items())
    + f" FROM b1), c AS (SELECT {_KEY} AS k, "
    + ", ".join(f"{sql} AS {name}" for name, sql in MEASURES.items())
    + ", CASE WHEN close >= mean20 THEN 1 ELSE -1 END AS s, "
    + ", ".join(CARRIED)
    + " FROM raw)"
)
_V5, _V15, _V60, _V240 = (f"CASE {x} WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END" for x in ("s5", "s15", "s60", "s240"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each hourly bar: measures of the bars up to it, and what the next one did."""
    b = hourly(spark, sf_dir)
    for columns in (NEIGHBOURS, MOVES):
        b = b.select("*", *[F.expr(sql).alias(name) for name, sql in columns.items()])
    df = b.select(F.expr(_KEY).alias("k"), *[F.expr(sql).alias(name) for name, sql in MEASURES.items()], *CARRIED)
    stacks = F.create_map(F.lit("5m"), F.col("s5"), F.lit("15m"), F.col("s15"), F.lit("1h"), F.col("s60"), F.lit("4h"), F.col("s240"))
    return df.withColumns({"s": S.sign_of(F.col("side")), "stacks": stacks})


def col(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


@query(
    doubles(
        f"""WITH {_CASES}
SELECT k, round(s * (CASE WHEN taker > 1.12 THEN 1 WHEN taker < 0.88 AND taker <> 0 THEN -1 ELSE 0 END) * 0.02, 6) AS flow,
  round(s * (CASE WHEN cvd > 0.12 THEN 1 WHEN cvd < -0.12 THEN -1 ELSE 0 END) * 0.018, 6) AS cvd_flow,
  round(s * (CASE WHEN advancers >= 58 AND median_change > 0 THEN 1 WHEN advancers <= 42 AND median_change < 0 THEN -1 ELSE 0 END) * 0.02, 6) AS breadth,
  round(s * (CASE WHEN interest >= 0.2 THEN sign(change) ELSE 0 END) * 0.02, 6) AS interest_trend,
  CASE WHEN side = 'long' AND funding > 0.03 OR side = 'short' AND funding < -0.03 THEN 0.025 ELSE 0 END AS funding_cost,
  CASE WHEN abs(funding_recent) >= 0.000001 AND abs(funding) / abs(funding_recent) >= 1.8 AND (side = 'long' AND funding > 0 OR side = 'short' AND funding < 0) THEN 0.01 ELSE 0 END AS funding_relative,
  CASE WHEN crowd <> 0 AND (side = 'long' AND crowd > 2 OR side = 'short' AND crowd < 0.5) THEN 0.015 ELSE 0 END AS crowding,
  CASE WHEN side = 'long' AND greed >= 75 OR side = 'short' AND greed <= 25 THEN 0.015 ELSE 0 END AS sentiment,
  CASE WHEN interest < -0.2 AND (side = 'long' AND change > 0.5 OR side = 'short' AND change < -0.5) THEN 0.012 ELSE 0 END AS interest_price,
  CASE WHEN barrier_pct < greatest(0.25, reward_pct * 0.35) THEN 0.025 ELSE 0 END AS level_cost
FROM c""",
        *("flow", "cvd_flow", "breadth", "interest_trend", "funding_cost", "funding_relative", "crowding", "sentiment", "interest_price", "level_cost"),
    )
)
def legacy_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and costs of single measures, one row for each case."""
    c, (s,) = cases(spark, sf_dir), col("s")
    return rounded(
        c.select(
            "k",
            S.flow_score(s, F.col("taker")).alias("flow"),
            S.cvd_score(s, F.col("cvd")).alias("cvd_flow"),
            S.breadth_score(s, *col("advancers", "median_change")).alias("breadth"),
            S.interest_score(s, *col("change", "interest")).alias("interest_trend"),
            S.funding_penalty(s, F.col("funding")).alias("funding_cost"),
            S.funding_relative_penalty(s, *col("funding", "funding_recent")).alias("funding_relative"),
            S.crowding_penalty(s, F.col("crowd")).alias("crowding"),
            S.sentiment_penalty(s, F.col("greed")).alias("sentiment"),
            S.interest_price_penalty(s, *col("change", "interest")).alias("interest_price"),
            S.level_penalty(*col("barrier_pct", "reward_pct")).alias("level_cost"),
        )
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with trend, rating, regime and contradictions."""
    s, horizon, stacks = col("s", "horizon", "stacks")
    c = cases(spark, sf_dir)
    parts = {"5m": "s5", "15m": "s15", "1h": "s60", "4h": "s240"}
    scores = {k: S.timeframe_score(s, F.col(v), *col("from_ema", "rsi")) for k, v in parts.items()}
    c = c.withColumns({"tf5": scores["5m"], "mean_score": S.weighted(scores, horizon), "trend": S.trend_score(s, stacks, horizon)})
    c = c.withColumns({"rating": S.technical_rating(s, *col("mean_score", "rsi", "from_ema", "atr", "barrier_pct", "reward_pct")), "regime": S.market_regime(s, stacks, *col("range_pct", "atr"))})
    c = c.withColumns({"bias": S.regime_bias(s, F.col("regime"), horizon), "higher": S.higher_penalty(s, stacks, horizon), "flow": S.flow_score(s, F.col("taker")), "cvd_flow": S.cvd_score(s, F.col("cvd"))})
    costs = [S.interest_price_penalty(s, *col("change", "interest")), S.level_penalty(*col("barrier_pct", "reward_pct")), F.col("higher")]
    return c.withColumn("contradiction", S.contradiction_penalty(*col("flow", "cvd_flow"), *costs))


_WEIGHTS = [(1.25, 1.35, 1.0, 0.45), (0.35, 1.1, 1.35, 1.0), (0.1, 0.2, 0.75, 1.5)]


def _mean(names: list[str]) -> str:
    """SQL of the mean of four timeframes by the horizon's weights."""
    one = lambda w: "(" + " + ".join(f"{n} * {x}::DOUBLE" for n, x in zip(names, w, strict=True)) + ") / (" + " + ".join(f"{x}::DOUBLE" for x in w) + ")"
    return f"CASE horizon WHEN 'intraday_wide' THEN {one(_WEIGHTS[1])} WHEN 'short_swing' THEN {one(_WEIGHTS[2])} ELSE {one(_WEIGHTS[0])} END"


_RSI = "CASE WHEN coalesce(rsi, 50) BETWEEN 45 AND 65 THEN 0.2 WHEN rsi > 75 THEN -0.25 WHEN rsi < 25 THEN 0.1 WHEN rsi >= 35 AND rsi < 45 THEN 0.05 ELSE 0 END::DOUBLE"
_JUDGED = (
    _CASES
    + f""", v AS (SELECT *, ({_V5})::DOUBLE AS v5, ({_V15})::DOUBLE AS v15, ({_V60})::DOUBLE AS v60, ({_V240})::DOUBLE AS v240,
  ({_RSI}) AS rs, CASE WHEN from_ema > 0.08 THEN 0.25 WHEN from_ema < -0.08 THEN -0.25 ELSE 0 END::DOUBLE AS fe FROM c
), t AS (SELECT *, greatest(-1, least(1, s * (v5 * 0.55::DOUBLE + fe + rs))) AS t5, greatest(-1, least(1, s * (v15 * 0.55::DOUBLE + fe + rs))) AS t15,
  greatest(-1, least(1, s * (v60 * 0.55::DOUBLE + fe + rs))) AS t60, greatest(-1, least(1, s * (v240 * 0.55::DOUBLE + fe + rs))) AS t240 FROM v
), m AS (SELECT *, {_mean(["t5", "t15", "t60", "t240"])} AS mean_score, s * ({_mean(["v5", "v15", "v60", "v240"])}) AS lean,
  s * CASE WHEN coalesce(rsi, 50) >= 72 THEN 1 WHEN coalesce(rsi, 50) <= 28 THEN -1 ELSE 0 END = 1 AND s * coalesce(from_ema, 0) > greatest(0.45, atr * 1.7) AS late,
  CASE WHEN reward_pct > 0 AND barrier_pct < reward_pct * 0.55 THEN 0.025 WHEN reward_pct > 0 AND barrier_pct < reward_pct * 0.85 THEN 0.012 ELSE 0 END AS barrier,
  (v5 = 1)::INT + (v15 = 1)::INT + (v60 = 1)::INT + (v240 = 1)::INT AS ups, (v5 = -1)::INT + (v15 = -1)::INT + (v60 = -1)::INT + (v240 = -1)::INT AS downs FROM t
), r AS (SELECT *, CASE WHEN range_pct < 0.45 AND atr < 0.08 THEN 'compresion' WHEN ups >= 3 THEN 'tendencia_alcista' WHEN downs >= 3 THEN 'tendencia_bajista'
    WHEN s * v240 = -1 THEN 'rebote_contra_tendencia' ELSE 'mixto' END AS regime,
  CASE horizon WHEN 'intraday_wide' THEN 1.0 WHEN 'short_swing' THEN 1.35 ELSE 0.6 END AS hw, CASE horizon WHEN 'intraday_wide' THEN 1.0 WHEN 'short_swing' THEN 1.15 ELSE 0.85 END AS rw,
  s * CASE WHEN horizon IN ('intraday_wide', 'short_swing') THEN v240 ELSE v60 END = -1 AS contra,
  s * (CASE WHEN taker > 1.12 THEN 1 WHEN taker < 0.88 AND taker <> 0 THEN -1 ELSE 0 END) AS fl, s * (CASE WHEN cvd > 0.12 THEN 1 WHEN cvd < -0.12 THEN -1 ELSE 0 END) AS cv FROM m
), j AS (SELECT *, CASE regime WHEN 'tendencia_alcista' THEN CASE WHEN s = 1 THEN 0.024 ELSE -0.028 END * rw WHEN 'tendencia_bajista' THEN CASE WHEN s = -1 THEN 0.024 ELSE -0.028 END * rw
    WHEN 'rebote_contra_tendencia' THEN -0.018 * hw ELSE 0 END AS bias, CASE WHEN contra THEN 0.018 * hw ELSE 0 END AS higher,
  (fl * cv < 0)::INT + coalesce(interest < -0.2 AND (s = 1 AND change > 0.5 OR s = -1 AND change < -0.5), false)::INT + coalesce(barrier_pct < greatest(0.25, reward_pct * 0.35), false)::INT + contra::INT AS against,
  round_even(greatest(0, least(100, mean_score * 50 + 50)), 0) AS score,
  CASE WHEN mean_score >= 0.45 THEN 6 WHEN mean_score <= -0.45 THEN -8 WHEN mean_score >= 0.15 THEN 3 WHEN mean_score <= -0.15 THEN -4 ELSE 0 END - CASE WHEN late THEN 4 ELSE 0 END - CASE WHEN barrier > 0 THEN 4 ELSE 0 END AS adjustment FROM r
), k2 AS (SELECT *, [0, 0, 0.018, 0.032, 0.045, 0.045][against + 1] AS contradiction FROM j)"""
)


@query(
    doubles(
        f"""WITH {_JUDGED}
SELECT k, round(t5, 6) AS tf5, round(mean_score, 6) AS mean_score,
  CASE WHEN lean >= 0.55 THEN 0.1 WHEN lean <= -0.55 THEN -0.09 WHEN lean >= 0.2 THEN 0.05 WHEN lean <= -0.2 THEN -0.05 ELSE 0 END AS trend, score,
  CASE WHEN mean_score >= 0.45 THEN 0.035 WHEN mean_score <= -0.45 THEN -0.04 WHEN mean_score >= 0.15 THEN 0.015 WHEN mean_score <= -0.15 THEN -0.02 ELSE 0 END AS direction_bias,
  CASE WHEN late THEN 0.02 ELSE 0 END AS entry_timing_penalty, barrier AS barrier_penalty, adjustment AS confidence_adjustment,
  CASE WHEN score >= 60 THEN 'favorable' WHEN score <= 40 THEN 'desfavorable' ELSE 'neutral' END AS label,
  regime, round(bias, 6) AS bias, round(higher, 6) AS higher, contradiction FROM k2""",
        *("trend", "direction_bias", "entry_timing_penalty", "barrier_penalty", "bias", "higher", "contradiction"),
    )
)
def legacy_technical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, technical rating, regime and contradictions of each order's timeframes."""
    return rounded(judged(spark, sf_dir).select("k", "tf5", "mean_score", "trend", "rating.*", "regime", "bias", "higher", "contradiction"))


_pct = lambda x, lo, hi: f"round_even(greatest(0, least(1, (({x}) - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE))) * 100, 0)"
_JUDGED_MONEY = (
    _JUDGED
    + f""", e AS (SELECT *, CASE WHEN regime IN ('compresion', 'mixto') THEN 0.12 WHEN contradiction >= 0.03 THEN 0.1 WHEN range_pct < 1.2 THEN 0.08 ELSE 0.06 END::DOUBLE AS rp, margin * leverage AS notional FROM k2
), f AS (SELECT *, notional * (greatest(spread / 100, 0.0002::DOUBLE) + 0.0008::DOUBLE) + notional * abs(coalesce(funding, 0)) / 100 AS cost FROM e
), g AS (SELECT *, notional * reward_pct / 100 - cost AS win, notional * risk_pct / 100 + cost AS loss FROM f
), h AS (SELECT *, tp * win - sl * loss - rp * cost AS value FROM g
), i AS (SELECT *, CASE WHEN notional <> 0 THEN round_even(value / notional * 100, 4) ELSE 0 END::DOUBLE AS of_notional FROM h
), l AS (SELECT *, greatest(0, round_even(greatest(0, least(100, {_pct("reward_pct / risk_pct", 0.8, 3.2)} * 0.16::DOUBLE + {_pct("of_notional", -0.8, 1.2)} * 0.22::DOUBLE + 0.6::DOUBLE - least(22, risk_pct * 4.5::DOUBLE) + 42)), 0)) AS quality,
  round_even(greatest(0, least(100, atr * 220 + 0.025::DOUBLE * (barrier > 0)::INT * 300 + {_pct("spread", 0, 0.08)} * 0.35::DOUBLE + 30)), 0) AS execution,
  greatest(15, least(95, round_even(bias::DOUBLE * 420, 0) + adjustment - round_even(contradiction::DOUBLE * 700, 0) - CASE WHEN contra THEN 12 ELSE 0 END - CASE WHEN fl * cv < 0 THEN 12 ELSE 0 END + 70)) AS sure,
  {_pct("of_notional", -1.0, 1.6)} AS value_score FROM i
), o AS (SELECT *, CASE WHEN tp >= 0.62::DOUBLE AND atr < 0.2::DOUBLE AND value_score >= 58 THEN 'A' WHEN tp >= 0.52::DOUBLE AND atr < 0.36::DOUBLE AND value_score >= 50 THEN 'B' WHEN tp >= 0.44::DOUBLE AND value_score >= 42 THEN 'C' ELSE 'D' END AS grade,
  CASE WHEN sure >= 76 THEN 'alta' WHEN sure >= 61 THEN 'media' WHEN sure >= 46 THEN 'media-baja' ELSE 'baja' END AS confidence FROM l
), q AS (SELECT *, CASE WHEN k % 31 = 0 OR value < 0 OR k % 5 = 0 THEN 'observar' WHEN grade IN ('A', 'B') AND confidence IN ('alta', 'media') THEN 'simular' WHEN grade IN ('B', 'C') THEN 'simular con tamano prudente' ELSE 'observar' END AS decision,
  CASE WHEN contradiction = 0 THEN 0.04 WHEN contradiction < 0.03 THEN 0.06 ELSE 0.08 END::DOUBLE AS width FROM o)"""
)


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir).withColumn("rp", S.range_probability(*col("range_pct", "contradiction", "regime")))
    j = j.withColumn("ev", S.expected_value(*col("margin", "leverage", "tp", "sl", "rp", "reward_pct", "risk_pct", "spread", "funding")))
    none = F.lit(0.0)
    j = j.withColumns(
        {
            "quality": S.quality_score(F.col("reward_pct") / F.col("risk_pct"), F.col("ev.of_notional"), F.lit(55.0), F.col("risk_pct"), none),
            "execution": S.execution_risk(F.col("atr"), F.when(F.col("rating.barrier_penalty") > 0, 0.025).otherwise(0.0), none, none, none, F.col("spread")),
            "sure": S.confidence_score(*col("contradiction", "higher", "bias", "flow", "cvd_flow"), F.col("rating.confidence_adjustment"), none),
            "value_score": S.to_percent(F.col("ev.of_notional"), -1.0, 1.6),
        }
    )
    j = j.withColumns({"grade": S.grade(*col("tp", "atr", "value_score")), "confidence": S.confidence(F.col("sure"))})
    level = F.when(F.col("k") % 5 == 0, "alto").otherwise("medio")
    return j.withColumn("decision", S.decision(F.col("grade"), level, F.col("confidence"), F.col("ev.value"), F.col("k") % 31 == 0))


@query(
    f"""WITH {_JUDGED_MONEY}
SELECT k, rp, notional, round_even(cost, 4) AS cost, round_even(win, 4) AS net_win, round_even(loss, 4) AS net_loss, round_even(value, 4) AS value, CASE WHEN margin <> 0 THEN round_even(value / margin * 100, 4) ELSE 0 END AS of_margin, of_notional,
  CASE WHEN value > 0 THEN 'positiva' WHEN value < 0 THEN 'negativa' ELSE 'neutral' END AS label, quality, execution, sure, value_score, grade,
  greatest(grade, ['A', 'B', 'C', 'D'][k % 4 + 1]) AS capped, confidence, decision, round_even(greatest(0.01, tp - width / 2), 4) AS tp_low, round_even(least(0.99, tp + width / 2), 4) AS tp_high,
  round_even(least(0.99, rp + least(width, 0.05) / 2), 4) AS range_high FROM q"""
)
def legacy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected value, layered scores, grade, confidence, decision and probability bands of each order."""
    bands = S.probability_bands(*col("tp", "sl", "rp", "contradiction"))
    cap = F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("k") % 4 + 1).cast("int"))
    m = money(spark, sf_dir).withColumn("bands", bands)
    return rounded(
        m.select("k", "rp", "ev.*", "quality", "execution", "sure", "value_score", "grade", S.capped(F.col("grade"), cap).alias("capped"), "confidence", "decision", F.col("bands.tp.low").alias("tp_low"), F.col("bands.tp.high").alias("tp_high"), F.col("bands.range.high").alias("range_high"))
    )


@query(
    f"""WITH {_JUDGED_MONEY}, w AS (SELECT *, CASE WHEN reason = 'take_profit' THEN 'plan_success' WHEN reason = 'stop_loss' THEN 'plan_failure' WHEN observation = 'manual_protected' THEN 'plan_would_fail'
    WHEN observation IN ('manual_left_profit', 'manual_better_than_plan') THEN 'plan_would_succeed' WHEN observation = 'plan_unresolved' THEN 'plan_unresolved' WHEN reason = 'contest_expired' THEN 'contest_expiry_mark_to_market' ELSE 'manual_pending_or_unclassified' END AS result,
  grade = 'D' OR confidence IN ('baja', 'media-baja') OR decision = 'observar' OR tp < sl OR value < 0 OR k % 8 = 0 AS warned FROM q)
SELECT k, result, warned, CASE WHEN result IN ('plan_success', 'plan_would_succeed') THEN CASE WHEN NOT warned AND (tp >= sl OR grade IN ('A', 'B', 'C')) THEN 'analysis_supported_success' ELSE 'success_against_analysis' END
    WHEN result IN ('plan_failure', 'plan_would_fail') THEN CASE WHEN warned AND k % 3 = 0 THEN 'analysis_warned_but_underweighted_risk' WHEN warned OR sl >= tp THEN 'analysis_warned_risk' ELSE 'analysis_missed_risk' END ELSE 'analysis_unresolved' END AS verdict,
  CASE WHEN reason IN ('manual', 'cut_loss', 'emotion') THEN CASE WHEN observation = 'manual_protected' THEN 'protected_capital' WHEN observation IN ('manual_left_profit', 'manual_worse_than_plan') THEN 'premature_or_worse_exit'
    WHEN observation = 'manual_better_than_plan' THEN 'better_than_plan' WHEN "trigger" IS NULL THEN 'inconclusive' ELSE 'pending_classification' END END AS quality,
  CASE WHEN wins + losses < 10 THEN 'early_observation' WHEN wins + losses < 30 THEN 'signal_to_monitor' WHEN wins + losses < 50 OR wins < 10 OR losses < 10 THEN 'candidate_for_formal_review' ELSE 'eligible_for_validation' END AS learning,
  CASE WHEN mean_r IS NOT NULL THEN CASE WHEN losses > wins AND mean_r < 0 THEN 'observed_risk_pattern' WHEN wins >= losses AND mean_r >= 0 THEN 'observed_winner_pattern' ELSE 'mixed_context_needs_review' END
    WHEN losses > wins THEN 'observed_risk_pattern' WHEN wins > losses THEN 'observed_winner_pattern' ELSE 'mixed_context_needs_review' END AS pattern,
  CASE WHEN cvd IS NULL THEN 'sin_dato' WHEN cvd > 0.003 THEN 'positivo' WHEN cvd < -0.003 THEN 'negativo' ELSE 'neutral' END AS signed_bucket,
  CASE WHEN greed IS NULL THEN 'sin_dato' WHEN greed < 35 THEN 'muy_bajo' WHEN greed < 45 THEN 'bajo' WHEN greed < 55 THEN 'neutral' WHEN greed < 65 THEN 'favorable' ELSE 'fuerte' END AS score_bucket,
  CASE WHEN interest IS NULL THEN 'sin_dato' WHEN interest < 0 THEN 'negativa' WHEN interest = 0 THEN 'neutral' ELSE 'positiva' END AS value_bucket,
  CASE WHEN leverage >= 8 THEN 'alto' WHEN leverage >= 4 THEN 'medio' ELSE 'bajo' END AS leverage_bucket FROM w"""
)
def legacy_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan results, verdicts, decision qualities, learning and pattern reads and buckets of each order."""
    m = money(spark, sf_dir).withColumn("result", S.plan_result(*col("reason", "observation")))
    fibonacci = F.when(F.col("k") % 8 == 0, "Alerta")
    m = m.withColumn("warned", S.warned(*col("tp", "sl", "grade", "confidence", "decision"), F.col("ev.value"), fibonacci, F.lit(0.0), F.lit(None).cast("double"), F.lit("bajo")))
    under = F.when(F.col("k") % 3 == 0, "risk_underweighted")
    return m.select(
        "k",
        "result",
        "warned",
        S.verdict(*col("result", "tp", "sl", "warned", "grade"), under).alias("verdict"),
        S.decision_quality(*col("reason", "observation", "trigger")).alias("quality"),
        S.learning_read(F.col("wins") + F.col("losses"), *col("wins", "losses")).alias("learning"),
        S.pattern_read(*col("wins", "losses", "mean_r")).alias("pattern"),
        S.signed_bucket(F.col("cvd")).alias("signed_bucket"),
        S.score_bucket(F.col("greed")).alias("score_bucket"),
        S.value_bucket(F.col("interest")).alias("value_bucket"),
        S.leverage_bucket(F.col("leverage")).alias("leverage_bucket"),
    )


@query(
    f"""WITH {_BARS}, e AS (SELECT symbol, open_ms, open, high, low, close, row_number() OVER (PARTITION BY symbol ORDER BY open_ms) AS n FROM bars
), p AS (SELECT *, CASE WHEN n % 2 = 0 THEN (high - close) ELSE (close - low) END / nullif(abs(high - low), 0) AS back, CASE WHEN n % 2 = 0 THEN 1 ELSE -1 END AS s, close * CASE WHEN n % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS target,
  CASE WHEN n % 7 <> 0 THEN CASE WHEN n % 2 = 0 THEN high ELSE low END END AS barrier FROM e
), d AS (SELECT *, CASE WHEN close = 0 THEN 0 ELSE abs((target - close) / close) * 100 END AS reward, (n % 20) / 4.0::DOUBLE AS atr, CASE WHEN close = 0 THEN 0 ELSE abs((barrier - close) / close) * 100 END AS way FROM p)
SELECT symbol, open_ms, CASE WHEN high = low THEN 'sin_rango' WHEN back < -0.03 THEN 'extension' WHEN back < 0.236 THEN 'ruptura_o_retroceso_muy_superficial' WHEN back < 0.382 THEN 'retroceso_superficial' WHEN back <= 0.618 THEN 'golden_zone'
    WHEN back <= 0.786 THEN 'retroceso_profundo' WHEN back <= 1 THEN 'retroceso_extremo' ELSE 'estructura_rota' END AS zone,
  CASE WHEN close > open AND open > low THEN 'bullish' WHEN close < open AND open < low THEN 'bearish' ELSE 'mixed' END AS stack,
  CASE WHEN reward <= 0 THEN 0 WHEN barrier IS NULL THEN 60 WHEN s * (barrier - close) > 0 AND s * (target - barrier) > 0 THEN round_even(greatest(15, least(55, {_pct("way", 0, "reward")} * 0.25::DOUBLE + 35)), 0)
    WHEN abs(target - barrier) / greatest(abs(barrier), 1e-6) * 100 <= greatest(0.12, atr * 0.45) THEN 70 ELSE 62 END AS path FROM d"""
)
def legacy_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retracement zone, stack and freedom of the way to a target at every bar."""
    bars = hourly(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("symbol").orderBy("open_ms")))
    even = F.col("n") % 2 == 0
    bars = bars.withColumns({"s": F.when(even, 1).otherwise(-1), "target": F.col("close") * F.when(even, 1.5).otherwise(0.5), "barrier": F.when(F.col("n") % 7 != 0, F.when(even, F.col("high")).otherwise(F.col("low")))})
    start, end = F.when(even, F.col("low")).otherwise(F.col("high")), F.when(even, F.col("high")).otherwise(F.col("low"))
    path = S.path_quality(*col("s", "close", "target", "barrier"), S.percent_of(*col("target", "close")), F.col("n") % 20 / 4.0)
    return bars.select("symbol", "open_ms", S.fibonacci_zone(F.col("close"), even, start, end).alias("zone"), S.ema_stack(*col("close", "open", "low")).alias("stack"), path.alias("path"))


# ---- rules on market context

DAY_BARS, SKEW_LIMIT_MS = 24, 500


def market_context(bars: DataFrame) -> DataFrame:
    """bars with the traces imbalance, interest, basis, mark, funding, spread, state and context."""
    t = Window.partitionBy("symbol").orderBy("open_ms")
    day = t.rowsBetween(1 - DAY_BARS, 0)
    behind = t.rangeBetween(1 - DAY_BARS * HOUR, 0)
    b = bars.withColumn("n", F.row_number().over(t))
    b = b.withColumn("rate", (F.col("n") % 13 - 6) / 10_000.0)
    event = F.when(F.col("open_ms") % (8 * HOUR) == 0, F.col("rate")).otherwise(0.0)
    b = b.withColumns(
        {
            "from_ms": F.lag("open_ms", DAY_BARS - 1).over(t),
            "buy": F.sum("taker_buy_quote").over(day),
            "sell": F.sum(F.col("quote_volume") - F.col("taker_buy_quote")).over(day),
            "old": F.lag(F.struct("close_ms", "volume", "close"), DAY_BARS).over(t),
            "load": F.sum(event).over(behind),
        }
    )
    # the window is covered where its bars have no gap
    seen = F.when(F.col("from_ms") == F.col("open_ms") - (DAY_BARS - 1) * HOUR, F.col("from_ms"))
    b = b.withColumns(
        {
            "imbalance": M.aggressor_imbalance(*col("buy", "sell"), F.col("open_ms") - (DAY_BARS - 1) * HOUR, F.col("close_ms"), seen, F.col("close_ms")),
            "interest": M.open_interest_change(F.col("old.volume"), F.col("volume"), F.col("old.close_ms"), F.col("close_ms"), DAY_BARS * HOUR),
            "basis": M.spot_basis(F.col("low"), F.col("high"), F.col("open"), F.col("open") * 1.001, F.col("n") % 7 * 100, SKEW_LIMIT_MS),
            "mark": M.mark_premium(*col("close", "open")),
            "funding": M.funding_state(F.col("rate"), F.lit(8.0), F.col("load"), F.lit(3).cast("long"), F.col("open_ms") - F.col("open_ms") % (8 * HOUR) + 8 * HOUR, float(DAY_BARS)),
            "spread": M.quoted_spread(*col("low", "high", "close_ms"), F.col("close_ms") + F.col("n") % 40 * 1000),
        }
    )
    source = F.when(F.col("n") % 2 == 0, "spot_futures").otherwise("mark_index")
    b = b.withColumns({"state": M.price_interest_state(F.ln(F.col("close") / F.col("old.close")), F.col("interest")), "context": M.derivatives_context(*col("imbalance", "interest", "funding"), source, *col("basis", "mark"))})
    return b


_CONTEXT = f"""{_BARS}, w AS (SELECT *, row_number() OVER t AS n, lag(open_ms, 23) OVER t AS from_ms, lag(close_ms, 24) OVER t AS old_ms, lag(volume, 24) OVER t AS old_volume, lag(close, 24) OVER t AS old_close,
    sum(taker_buy_quote) OVER d AS buy, sum(quote_volume - taker_buy_quote) OVER d AS sell FROM bars
  WINDOW t AS (PARTITION BY symbol ORDER BY open_ms), d AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING)
), f AS (SELECT *, (n % 13 - 6) / 10000.0::DOUBLE AS rate, sum(CASE WHEN open_ms % 28800000 = 0 THEN (n % 13 - 6) / 10000.0::DOUBLE ELSE 0 END) OVER (PARTITION BY symbol ORDER BY open_ms RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS load FROM w
), r AS (SELECT *, CASE WHEN buy + sell <= 0 THEN 'zero_activity' WHEN from_ms = open_ms - 82800000 THEN 'ok' ELSE 'incomplete_window_coverage' END AS a, CASE WHEN close_ms - old_ms = 86400000 THEN 'ok' ELSE 'open_interest_alignment_error' END AS o,
    CASE WHEN n % 7 * 100 <= 500 THEN 'ok' ELSE 'basis_capture_skew_exceeded' END AS b, CASE WHEN (n % 40) * 1000 <= 30000 THEN 'ok' ELSE 'stale_quoted_book' END AS q FROM f)"""
#: Measures of the context as they are, for queries that go on from them.
SQL_CONTEXT = (
    f"WITH {_CONTEXT} SELECT symbol, open_ms, n_trades, rate, CASE WHEN a = 'ok' THEN (buy - sell) / (buy + sell) END AS imbalance_raw, CASE WHEN o = 'ok' THEN ln(volume / old_volume) END AS interest_raw,"
    " CASE WHEN o = 'ok' AND old_close IS NOT NULL THEN 'known' END AS state, ln(close / old_close) AS moved, CASE WHEN b = 'ok' THEN ln((low + high) / (open + open * 1.001::DOUBLE)) END AS basis_raw, ln(close / open) AS premium_raw FROM r"
)


@query(
    f"""WITH {_CONTEXT}
SELECT symbol, open_ms, nullif(a, 'ok') AS imbalance_reason, CASE WHEN a = 'ok' THEN round((buy - sell) / (buy + sell), 6) END AS imbalance, nullif(o, 'ok') AS interest_reason, CASE WHEN o = 'ok' THEN round(ln(volume / old_volume), 6) END AS interest,
  CASE WHEN o = 'ok' AND old_close IS NOT NULL THEN 'price_' || CAST(sign(ln(close / old_close)) AS INT) || '_oi_' || CAST(sign(ln(volume / old_volume)) AS INT) END AS state,
  nullif(b, 'ok') AS basis_reason, CASE WHEN b = 'ok' THEN round(ln((low + high) / (open + open * 1.001::DOUBLE)), 6) END AS basis, round(ln(close / open), 6) AS premium, round(rate / 8, 9) AS per_hour, round(load, 9) AS load, CAST(3 AS BIGINT) AS scheduled,
  open_ms - open_ms % 28800000 + 28800000 AS next_ms, CASE WHEN a <> 'ok' OR o <> 'ok' OR n % 2 = 0 AND b <> 'ok' THEN 'blocked' ELSE 'evaluated' END AS context_status,
  CASE WHEN NOT (a <> 'ok' OR o <> 'ok' OR n % 2 = 0 AND b <> 'ok') THEN round(CASE WHEN n % 2 = 0 THEN ln((low + high) / (open + open * 1.001::DOUBLE)) ELSE ln(close / open) END, 6) END AS context_basis,
  nullif(q, 'ok') AS spread_reason, CASE WHEN q = 'ok' THEN round((high - low) / ((low + high) / 2), 6) END AS spread_fraction FROM r"""
)
def market_context_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance, open interest, basis, premium, funding, their context and the quoted spread at every bar."""
    b = market_context(hourly(spark, sf_dir))
    out = b.select(
        "symbol",
        "open_ms",
        F.col("imbalance.reason").alias("imbalance_reason"),
        F.col("imbalance.imbalance").alias("imbalance"),
        F.col("interest.reason").alias("interest_reason"),
        F.col("interest.change").alias("interest"),
        F.col("state.state").alias("state"),
        F.col("basis.reason").alias("basis_reason"),
        F.col("basis.basis").alias("basis"),
        F.col("mark.premium").alias("premium"),
        F.round("funding.per_hour", 9).alias("per_hour"),
        F.round("funding.load", 9).alias("load"),
        F.col("funding.scheduled").alias("scheduled"),
        F.col("funding.next_ms").alias("next_ms"),
        F.col("context.status").alias("context_status"),
        F.col("context.basis").alias("context_basis"),
        F.col("spread.reason").alias("spread_reason"),
        F.col("spread.fraction").alias("spread_fraction"),
    )
    return rounded(out, but=("per_hour", "load"))


# ---- rules on money

_MONEY_RULES = f"""WITH {_CASES}, x AS (SELECT *, margin * leverage AS notional, margin * leverage / entry AS qty, entry * (1 + s * reward_pct / 100) AS target, entry * (1 - s * (risk_pct - CASE WHEN k % 11 = 0 THEN 4 ELSE 0 END) / 100) AS stop FROM c
), y AS (SELECT *, s * qty * (target - entry) AS reward, s * qty * (entry - stop) AS risk FROM x
), z AS (SELECT *, CASE WHEN margin <= 0 THEN 'invalid_input' WHEN reward > 0 AND risk > 0 THEN 'ok' ELSE 'invalid_exposure_geometry' END AS e,
  CASE WHEN k % 9 = 0 THEN 'missing_commission_rate' WHEN k % 10 = 0 THEN 'invalid_liquidity_roles' ELSE 'ok' END AS f, CASE WHEN margin <= 0 THEN 'invalid_input' WHEN k % 3 = 0 AND k % 4 <> 0 THEN 'future_funding_rate_unknown' ELSE 'ok' END AS g FROM y)"""


@query(
    _MONEY_RULES
    + """, u AS (SELECT *, CASE WHEN g = 'ok' THEN CASE WHEN k % 3 = 0 THEN 0 ELSE -s * qty * entry * 0.0001::DOUBLE - s * qty * (entry + 1) * 0.0003::DOUBLE END END AS flow, e = 'ok' AND f = 'ok' AND g = 'ok' AS all_ FROM z
), p AS (SELECT *, reward - notional * 0.0005::DOUBLE - notional * 0.0002::DOUBLE + flow AS net_tp, -risk - notional * 0.0005::DOUBLE - notional * 0.0002::DOUBLE + flow AS net_sl FROM u)
SELECT k, nullif(e, 'ok') AS exposure_reason, CASE WHEN e = 'ok' THEN round(reward, 6) END AS reward, CASE WHEN e = 'ok' THEN round(risk, 6) END AS risk, CASE WHEN e = 'ok' THEN round(reward / risk, 6) END AS reward_risk, CASE WHEN e = 'ok' THEN round(risk / margin, 6) END AS of_margin,
  nullif(f, 'ok') AS fee_reason, CASE WHEN f = 'ok' THEN round(notional * CASE WHEN k % 8 = 0 THEN 0.0005 ELSE 0.0002 END, 6) END AS fee_low, CASE WHEN f = 'ok' THEN round(notional * 0.0005::DOUBLE, 6) END AS fee_high, CASE WHEN f = 'ok' THEN k % 8 = 0 AND k % 6 = 0 END AS fee_exact,
  CASE g WHEN 'ok' THEN 'evaluated' WHEN 'invalid_input' THEN 'blocked' ELSE 'deferred' END AS funding_status, round(flow, 6) AS flow, CASE WHEN all_ THEN round(net_tp, 6) END AS net_tp, CASE WHEN all_ THEN round(net_sl, 6) END AS net_sl,
  CASE WHEN k % 12 = 0 THEN 'm6_probabilities_unavailable' WHEN NOT all_ THEN 'expected_value_key_mismatch' WHEN k % 14 = 0 THEN 'probability_mass_not_one' END AS value_reason,
  CASE WHEN all_ AND k % 12 <> 0 AND k % 14 <> 0 THEN round(tp * net_sl + tp * net_tp * 0 + (1 - tp) * net_tp, 6) END AS value,
  CASE WHEN k % 15 = 0 THEN 'invalid_readiness_status' END AS ready_reason, CASE WHEN k % 15 <> 0 THEN e = 'ok' AND k % 21 <> 0 END AS economic, CASE WHEN k % 15 <> 0 THEN k % 2 = 0 END AS account FROM p"""
)
def money_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure, fees, funding, net payoffs, expected value and readiness of each order."""
    k, s, entry = col("k", "s", "entry")
    c = cases(spark, sf_dir).withColumns(
        {"target": entry * (1 + s * F.col("reward_pct") / 100), "stop": entry * (1 - s * (F.col("risk_pct") - F.when(k % 11 == 0, 4).otherwise(0)) / 100), "notional": F.col("margin") * F.col("leverage"), "qty": F.col("margin") * F.col("leverage") / entry}
    )
    rates = F.when(k % 9 == 0, F.create_map(F.lit("maker"), F.lit(0.0002))).otherwise(F.create_map(F.lit("maker"), F.lit(0.0002), F.lit("taker"), F.lit(0.0005)))
    roles = F.when(k % 9 == 0, F.array(F.lit("taker"))).when(k % 10 == 0, F.array(F.lit("other"))).when(k % 8 == 0, F.array(F.lit("taker"), F.lit("taker"))).otherwise(F.array(F.lit("taker"), F.lit("maker")))
    event = lambda mark, rate: F.struct(mark.alias("mark"), F.lit(rate).alias("rate"))
    some = F.array(event(entry, 0.0001), event(entry + 1, 0.0003))
    events = F.when(k % 3 == 0, F.filter(some, lambda e: F.lit(False))).otherwise(some)
    c = c.withColumns(
        {
            "exposure": M.plan_exposure(*col("side", "entry", "target", "stop", "margin", "leverage")),
            "fees": M.fee_scenarios(F.col("notional"), rates, roles, k % 6 == 0, F.lit("USDT")),
            "cash": M.funding_cashflow(F.col("side"), F.col("qty"), events, k % 4),
        }
    )
    done = (F.col("exposure.status") == "evaluated") & (F.col("fees.status") == "evaluated") & (F.col("cash.status") == "evaluated")
    pair = lambda a, b: F.create_map(F.lit("tp"), a, F.lit("sl"), b)
    cost = F.col("notional") * 0.0005
    gross = F.when(done, pair(F.col("exposure.reward"), -F.col("exposure.risk"))).otherwise(F.create_map(F.lit("tp"), F.lit(0.0)))
    c = c.withColumn("net", M.net_payoffs(gross, pair(cost, cost), pair(F.col("notional") * 0.0002, F.col("notional") * 0.0002), pair(*[F.coalesce("cash.total", F.lit(0.0))] * 2)))
    probabilities = F.when(k % 14 == 0, pair(F.lit(0.5), F.lit(0.6))).otherwise(pair(1 - F.col("tp"), F.col("tp")))
    payoffs = F.coalesce("net.net", F.create_map(F.lit("tp"), F.lit(0.0)))
    state = {p: F.lit("available") for p in M.READY_PARTS}
    state["payoffs"] = F.when(F.col("exposure.status") == "evaluated", "available").otherwise("blocked")
    state["funding"] = F.when(k % 15 == 0, "odd").when(k % 21 == 0, "blocked").otherwise("not_applicable")
    state["account_risk"] = F.when(k % 2 == 0, "available").otherwise("not_applicable")
    statuses = F.create_map(*[x for p, v in state.items() for x in (F.lit(p), v)])
    c = c.withColumns({"ev": M.expected_value(probabilities, payoffs, k % 12 != 0), "ready": M.readiness(statuses)})
    return rounded(
        c.select(
            "k",
            F.col("exposure.reason").alias("exposure_reason"),
            *[F.col(f"exposure.{n}").alias(n) for n in ("reward", "risk", "reward_risk", "of_margin")],
            F.col("fees.reason").alias("fee_reason"),
            F.col("fees.lower").alias("fee_low"),
            F.col("fees.upper").alias("fee_high"),
            F.col("fees.is_exact").alias("fee_exact"),
            F.col("cash.status").alias("funding_status"),
            F.col("cash.total").alias("flow"),
            F.col("net.net")["tp"].alias("net_tp"),
            F.col("net.net")["sl"].alias("net_sl"),
            F.col("ev.reason").alias("value_reason"),
            F.col("ev.value").alias("value"),
            F.col("ready.reason").alias("ready_reason"),
            F.col("ready.is_economic").alias("economic"),
            F.col("ready.is_account").alias("account"),
        )
    )
