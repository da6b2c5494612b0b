"""The overlay of rules on first-passage probabilities, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _FP, hourly, moved_plans, query, rounded, rule_traces, with_first_passage
from tapewright.plans import overlay
from tapewright.rule_queries import SQL_CONTEXT, market_context
from tapewright.storage import stored

_HORIZON = "CASE WHEN n_trades >= 4 THEN 'intraday_short' WHEN n_trades = 3 THEN 'intraday_wide' ELSE 'short_swing' END"


def _share(rule: str) -> str:
    return "CASE horizon " + " ".join(f"WHEN '{h}' THEN {s[rule]}::DOUBLE" for h, s in overlay.SHARES.items()) + " END"


_SIGNALS = {
    "path_structure": ("efficiency IS NOT NULL", "d * efficiency"),
    "regime": ("efficiency IS NOT NULL AND rk IS NOT NULL", "greatest(-1, least(1, d * efficiency * (2 * rk - 1)))"),
    "imbalance": ("imbalance IS NOT NULL", "d * imbalance"),
    "interest": ("interest IS NOT NULL", "tanh(50 * abs(interest))"),
    "price_interest": ("state IS NOT NULL AND moved IS NOT NULL", "d * sign(moved) * tanh(50 * interest)"),
    "basis": ("basis IS NOT NULL", "-d * tanh(100 * basis)"),
    "premium": ("premium IS NOT NULL", "-d * tanh(200 * premium)"),
    "funding": ("rate IS NOT NULL", "-d * tanh(rate / 0.0005::DOUBLE)"),
}


def _fold(skip: str | None) -> str:
    """SQL of the fold, rule by rule, without one of them: nested selects over tp, sl, none_."""
    sql = "SELECT *, p_tp AS tp, p_sl AS sl, p_expiry AS none_ FROM effects"
    for rule in overlay.WEIGHTS:
        if rule == skip:
            continue
        e = f"coalesce(e_{rule}, 0)"
        if rule in overlay.MOVEMENT:
            after = f"((tp + sl) * exp({e}) / ((tp + sl) * exp({e}) + none_ * exp(-{e})))"
            new = f"{after} * tp / (tp + sl) AS tp, {after} * (1 - tp / (tp + sl)) AS sl, 1 - {after} AS none_"
        else:
            share = f"(tp * exp({e}) / (tp * exp({e}) + sl * exp(-{e})))"
            new = f"(tp + sl) * {share} AS tp, (tp + sl) * (1 - {share}) AS sl, none_ AS none_"
        sql = f"SELECT * REPLACE ({new}) FROM ({sql})"
    return sql


_OVERLAY = (
    _FP
    + f""", mc AS ({SQL_CONTEXT}), pf2 AS (
  SELECT f.symbol, f.open_ms, f.rv, CASE WHEN f.var > 0 THEN f.disp / f.var END AS efficiency, list(CASE WHEN n > 24 THEN rv END) OVER (PARTITION BY symbol, n % 24 ORDER BY open_ms ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS ref FROM feats f), ranked AS (
  SELECT *, CASE WHEN len(ref) = 10 THEN (len(list_filter(ref, lambda x: x < rv)) + 0.5::DOUBLE * len(list_filter(ref, lambda x: x = rv))) / 10 END AS rk FROM pf2), joined AS (
  SELECT probs.plan_id, round((p_tp + 0.01::DOUBLE) / 1.03::DOUBLE, 9) AS p_tp, round((p_sl + 0.01::DOUBLE) / 1.03::DOUBLE, 9) AS p_sl, round((p_expiry + 0.01::DOUBLE) / 1.03::DOUBLE, 9) AS p_expiry, CASE WHEN (r.open_ms // 3600000) % 2 = 0 THEN 1 ELSE -1 END AS d, efficiency, rk, mc.imbalance_raw AS imbalance, mc.interest_raw AS interest, mc.state, mc.moved, mc.basis_raw AS basis, mc.premium_raw AS premium, mc.rate,
         {_HORIZON} AS horizon
  FROM probs JOIN ranked r ON probs.plan_id = r.symbol || '/' || r.open_ms JOIN mc ON mc.symbol = r.symbol AND mc.open_ms = r.open_ms), effects AS (
  SELECT *, """
    + ", ".join(f"CASE WHEN {ok} THEN {overlay.WEIGHTS[n]}::DOUBLE * {_share(n)} * ({sql}) END AS e_{n}" for n, (ok, sql) in _SIGNALS.items())
    + " FROM joined WHERE p_tp > 0 AND p_sl > 0 AND p_expiry > 0), whole AS ("
    + _fold(None)
    + ")"
    + "".join(f", no_{n} AS (SELECT plan_id, tp AS x_{n} FROM ({_fold(n)}))" for n in overlay.WEIGHTS)
)


@query(
    f"WITH {_OVERLAY} SELECT plan_id, "
    + " + ".join(f"(e_{n} IS NOT NULL)::INT" for n in overlay.WEIGHTS)
    + " AS rules, round(tp, 6) AS tp, round(sl, 6) AS sl, round(none_, 6) AS none_, "
    + ", ".join(f"CASE WHEN e_{n} IS NOT NULL THEN round(tp - x_{n}, 6) + 0.0 END AS by_{n}" for n in overlay.WEIGHTS)
    + " FROM whole "
    + " ".join(f"JOIN no_{n} USING (plan_id)" for n in overlay.WEIGHTS)
)
def rule_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-passage probabilities, a little smoothed so that none is 0, after eight rules' bounded effects, and what each rule alone does to the target's."""
    bars = stored(hourly(spark, sf_dir), "bars")
    plans = with_first_passage(moved_plans(bars)).withColumn("open_ms", F.col("at_ms") - 3_600_000 + 1)
    rules = rule_traces(spark, sf_dir, bars).select("symbol", "open_ms", "path_structure", "regime")
    context = market_context(bars).select("symbol", "open_ms", "n_trades", "imbalance", "interest", "state", "basis", "mark", "funding", "rate")
    df = plans.select("plan_id", "symbol", "open_ms", "side", *[F.round((F.col(c) + 0.01) / 1.03, 9).alias(c) for c in ("p_tp", "p_sl", "p_expiry")]).join(rules, ["symbol", "open_ms"]).join(context, ["symbol", "open_ms"])
    col = F.col
    measures = {"efficiency": col("path_structure.efficiency"), "volatility_rank": col("regime.volatility"), "imbalance": col("imbalance.imbalance"), "interest": col("interest.change"), "displacement": col("state.displacement"), "basis": col("basis.basis"), "premium": col("mark.premium"), "funding": col("rate")}
    statuses = {n: col(f"{t}.status") for n, t in (("path_structure", "path_structure"), ("regime", "regime"), ("imbalance", "imbalance"), ("interest", "interest"), ("price_interest", "state"), ("basis", "basis"), ("premium", "mark"), ("funding", "funding"))}
    found = overlay.signals(col("side") == "long", measures)
    df = df.withColumn("rules", overlay.active_rules(F.expr(_HORIZON), statuses, found)).withColumn("p", F.struct(col("p_tp").alias("tp"), col("p_sl").alias("sl"), col("p_expiry").alias("none")))
    df = df.withColumn("after", overlay.folded(col("p"), col("rules"))).where("after is not null").withColumn("parts", overlay.contributions(col("p"), col("rules"), col("after")))
    by = F.map_from_entries(F.transform("parts", lambda x: F.struct(x["rule"], x["tp"])))
    out = df.select("plan_id", F.size("rules").alias("rules"), "after.tp", "after.sl", col("after.none").alias("none_"), *[F.try_element_at(by, F.lit(n)).alias(f"by_{n}") for n in overlay.WEIGHTS])
    return rounded(out)
