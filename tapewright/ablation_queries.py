"""Ablations of the probabilities' components over the cases, with their SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import query, rounded
from tapewright.functions import scoring as S
from tapewright.operators import ablations as A
from tapewright.rule_queries import _JUDGED_MONEY, col, doubles, money

#: Components in order with their signs, and SQL of their values; the last three adjust late: the probability, and the range.
SIGNS = {"market_regime_bias": 1.0, "taker_flow_bias": 1.0, "cvd_bias": 1.0, "breadth_bias": 1.0, "funding_penalty": -1.0, "crowding_penalty": -1.0, "level_penalty": -1.0, "higher_timeframe_penalty": -1.0, "technical_barrier_penalty": -1.0, "contradiction_penalty": -1.0}
UNITS = [*SIGNS, "risk_calibration_tp_adjustment", "zone_range_probability_adjustment", "risk_calibration_range_adjustment"]
_VALUES = [
    "bias",
    "fl * 0.02",
    "cv * 0.018",
    "s * (CASE WHEN advancers >= 58 AND median_change > 0 THEN 1 WHEN advancers <= 42 AND median_change < 0 THEN -1 ELSE 0 END) * 0.02",
    "CASE WHEN side = 'long' AND funding > 0.03 OR side = 'short' AND funding < -0.03 THEN 0.025 ELSE 0 END",
    "CASE WHEN crowd <> 0 AND (side = 'long' AND crowd > 2 OR side = 'short' AND crowd < 0.5) THEN 0.015 ELSE 0 END",
    "CASE WHEN barrier_pct < greatest(0.25, reward_pct * 0.35) THEN 0.025 ELSE 0 END",
    "higher",
    "barrier",
    "contradiction",
    "CASE WHEN tp < sl THEN -0.02 ELSE 0 END",
    "CASE WHEN spread > 0.04 THEN 0.015 ELSE 0 END",
    "CASE WHEN n_trades = 1 THEN 0.02 WHEN n_trades > 5 THEN -0.01 ELSE 0 END",
]


def _replayed(v: str) -> str:
    n = len(SIGNS)
    score = "0.5::DOUBLE" + "".join(f" {'+' if s > 0 else '-'} {v}[{i + 1}]" for i, s in enumerate(SIGNS.values()))
    tp = f"greatest(0.22::DOUBLE, least(0.74::DOUBLE, greatest(0.26::DOUBLE, least(0.74::DOUBLE, {score})) + {v}[{n + 1}]))"
    base = f"CASE WHEN regime IN ('compresion', 'mixto') THEN 0.12::DOUBLE WHEN {v}[{n}] >= 0.03::DOUBLE THEN 0.1::DOUBLE WHEN range_pct < 1.2::DOUBLE THEN 0.08::DOUBLE ELSE 0.06::DOUBLE END"
    wide = f"greatest(0.04::DOUBLE, least(0.22::DOUBLE, least(0.2::DOUBLE, {base} + {v}[{n + 2}]) + {v}[{n + 3}]))"
    return f"{{'tp': {tp}, 'range': {wide}}}"


_ABLATED = (
    _JUDGED_MONEY
    + f", cc AS (SELECT regime, range_pct, win, loss, cost, list_transform([{', '.join(f'({x})::DOUBLE' for x in _VALUES)}], lambda x: coalesce(x, 0)) AS v FROM q)"
    + f", ww AS (SELECT *, {_replayed('v')} AS w FROM cc), un AS (SELECT unnest([{', '.join(repr(u) for u in UNITS)}]) AS unit, unnest(range(1, {len(UNITS) + 1})) AS i)"
    + f", oo AS (SELECT *, {_replayed('x')} AS o FROM (SELECT *, list_transform(v, lambda y, j: CASE WHEN j = i THEN 0 ELSE y END) AS x FROM ww, un))"
    + """, dd AS (SELECT *, greatest(0.05::DOUBLE, 1 - w.tp - w."range") AS wsl, greatest(0.05::DOUBLE, 1 - o.tp - o."range") AS osl FROM oo), vv AS (
  SELECT *, w.tp * win - wsl * loss - w."range" * cost AS ev, o.tp * win - osl * loss - o."range" * cost AS oev FROM dd)"""
)


@query(
    doubles(
        f"""WITH {_ABLATED} SELECT unit, count(*) AS cases, count(*) FILTER (v[i] <> 0) AS active, count(*) FILTER (abs(o.tp - w.tp) >= 0.0001) AS tp_changed, count(*) FILTER (abs(osl - wsl) >= 0.0001) AS sl_changed,
  count(*) FILTER (abs(o."range" - w."range") >= 0.0001) AS range_changed, count(*) FILTER (ev >= 0 AND oev < 0 OR ev < 0 AND oev >= 0) AS ev_sign_changed,
  round(sum(abs(o.tp - w.tp)), 5) AS sum_tp, round(max(abs(o.tp - w.tp)), 6) AS max_tp, round(sum(abs(oev - ev)), 4) AS sum_ev, round(max(abs(oev - ev)), 5) AS max_ev FROM vv GROUP BY unit""",
        "sum_tp",
        "max_tp",
        "sum_ev",
        "max_ev",
    )
)
def score_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every case's probabilities replayed without each of their components."""
    m, s = money(spark, sf_dir), F.col("s")
    values = {
        "market_regime_bias": F.col("bias"),
        "taker_flow_bias": F.col("flow"),
        "cvd_bias": F.col("cvd_flow"),
        "breadth_bias": S.breadth_score(s, *col("advancers", "median_change")),
        "funding_penalty": S.funding_penalty(s, F.col("funding")),
        "crowding_penalty": S.crowding_penalty(s, F.col("crowd")),
        "level_penalty": S.level_penalty(*col("barrier_pct", "reward_pct")),
        "higher_timeframe_penalty": F.col("higher"),
        "technical_barrier_penalty": F.col("rating.barrier_penalty"),
        "contradiction_penalty": F.col("contradiction"),
        "risk_calibration_tp_adjustment": F.when(F.col("tp") < F.col("sl"), -0.02).otherwise(0.0),
        "zone_range_probability_adjustment": F.when(F.col("spread") > 0.04, 0.015).otherwise(0.0),
        "risk_calibration_range_adjustment": F.when(F.col("n_trades") == 1, 0.02).when(F.col("n_trades") > 5, -0.01).otherwise(0.0),
    }
    notional = F.col("margin") * F.col("leverage")
    cost = notional * (F.greatest(F.col("spread") / 100, F.lit(0.0002)) + 0.0008) + notional * F.abs(F.coalesce("funding", F.lit(0.0))) / 100
    rows = m.select(F.array(*[values[u].cast("double") for u in UNITS]).alias("components"), "regime", "range_pct", (notional * F.col("reward_pct") / 100 - cost).alias("win"), (notional * F.col("risk_pct") / 100 + cost).alias("loss"), cost.alias("cost"))
    out = A.ablations(rows, UNITS, list(SIGNS.values()), "contradiction_penalty")
    return rounded(out, 6, but=("sum_tp", "sum_ev", "max_ev")).withColumns({"sum_tp": F.round("sum_tp", 5), "sum_ev": F.round("sum_ev", 4), "max_ev": F.round("max_ev", 5)})
