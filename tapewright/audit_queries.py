"""Queries of the audits, prediction metrics, scalings and cluster reads, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.catalog import query, rounded
from tapewright.operators import audits as A
from tapewright.rule_queries import _CASES, cases

#: Flags and measures of a case's outcome, in SQL that both engines read.
FLAGS = {
    "success": "reason = 'take_profit'",
    "failure": "reason = 'stop_loss'",
    "target_touched": "CASE WHEN s > 0 THEN next_high >= entry * CAST(1.1 AS DOUBLE) ELSE next_low <= entry * CAST(0.9 AS DOUBLE) END",
    "adverse_touched": "CASE WHEN s > 0 THEN next_low <= entry * CAST(0.9 AS DOUBLE) ELSE next_high >= entry * CAST(1.1 AS DOUBLE) END",
    "forecast_correct": "CASE WHEN reason IN ('take_profit', 'stop_loss') THEN (tp >= sl) = (reason = 'take_profit') END",
    "activated": "n_trades > 1",
    "underweighted": "reason = 'stop_loss' AND tp > sl",
}
_AGAINST = "CASE WHEN s > 0 THEN 'bearish' ELSE 'bullish' END"
SCORES = {"score": "rsi", "opposing": "CAST(" + " + ".join(f"CASE WHEN {x} = {_AGAINST} THEN 1 ELSE 0 END" for x in ("s5", "s15", "s60", "s240")) + " AS DOUBLE)"}
_ZONE = "CASE WHEN n > 24 THEN s240 END"
_CASE_ROWS = _CASES + ", x AS (SELECT *, " + ", ".join(f"{sql} AS {n}" for n, sql in (FLAGS | SCORES | {"zone": _ZONE}).items()) + " FROM c)"
_RATES = ", ".join(f"count(*) FILTER ({f}) AS {f}, round(avg({f}::INT), 6) AS {f}_rate" for f in FLAGS)


@query(
    f"""WITH {_CASE_ROWS}, g AS (SELECT 'all' AS key, 'all' AS name, x.* FROM x UNION ALL SELECT 'horizon', horizon, x.* FROM x UNION ALL SELECT 'zone', coalesce(zone, 'sin_dato'), x.* FROM x UNION ALL SELECT 'side', side, x.* FROM x)
SELECT key, name, count(*) AS cases, {_RATES}, round(avg(score), 6) AS avg_score, round(avg(opposing), 6) AS avg_opposing FROM g GROUP BY key, name"""
)
def case_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, rates and means of all cases and by horizon, zone and side."""
    rows = cases(spark, sf_dir).withColumn("zone", F.expr(_ZONE))
    return rounded(A.case_groups(rows, ["horizon", "zone", "side"], {n: F.expr(x) for n, x in FLAGS.items()}, {n: F.expr(x) for n, x in SCORES.items()}))


_LABEL = "CASE WHEN reason IN ('take_profit', 'stop_loss') THEN reason ELSE 'expiry' END"
#: Probabilities of target and stop: by the place in the day's range, and by how many bars rose and fell.
_MODELS = {"plain": ("tp * CAST(0.8 AS DOUBLE)", "sl * CAST(0.8 AS DOUBLE)"), "other": ("CAST(wins + 1 AS DOUBLE) / (wins + losses + 4)", "CAST(losses + 1 AS DOUBLE) / (wins + losses + 4)")}
_ASK = "concat(symbol, '/', CAST(CAST(floor(open_ms / 86400000) AS BIGINT) AS VARCHAR(20)))"
_SEEN = ("coalesce(rsi, CAST(50 AS DOUBLE)) / 10", "coalesce(from_ema, CAST(0 AS DOUBLE)) * 10")
_PREDICTED = (
    _CASES
    + ", m AS ("
    + " UNION ALL ".join(f"SELECT k, horizon, {_LABEL} AS label, '{n}' AS model, {p0} AS p0, {p1} AS p1 FROM c" for n, (p0, p1) in _MODELS.items())
    + """), n AS (SELECT *, 1 - p0 - p1 AS p2 FROM m), o AS (SELECT *, CASE label WHEN 'take_profit' THEN p0 WHEN 'stop_loss' THEN p1 ELSE p2 END AS own, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'take_profit' WHEN p1 >= p2 THEN 'stop_loss' ELSE 'expiry' END AS top FROM n
), a AS (SELECT model, horizon, count(*) AS records, avg((p0 - (label = 'take_profit')::INT) ** 2 + (p1 - (label = 'stop_loss')::INT) ** 2 + (p2 - (label = 'expiry')::INT) ** 2) AS brier, avg(-ln(greatest(own, 1e-15))) AS log_loss, avg((top = label)::INT) AS accuracy, avg(own) AS mean_probability,
  count(*) FILTER (label <> 'expiry') AS binary_records, avg(CASE WHEN label <> 'expiry' THEN ((p0 >= p1) = (label = 'take_profit'))::INT END) AS binary_accuracy, """
    + ", ".join(f"count(*) FILTER (label = '{a}' AND top = '{b}') AS {a}_as_{b}" for a in A.CLASSES for b in A.CLASSES)
    + " FROM o GROUP BY model, horizon)"
)


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.expr(p0).alias("p0"), F.expr(p1).alias("p1")) for n, (p0, p1) in _MODELS.items()])
    rows = cases(spark, sf_dir).select("horizon", F.expr(_LABEL).alias("label"), F.explode(models).alias("m")).select("horizon", "label", "m.*")
    p = F.create_map(F.lit(A.CLASSES[0]), F.col("p0"), F.lit(A.CLASSES[1]), F.col("p1"), F.lit(A.CLASSES[2]), 1 - F.col("p0") - F.col("p1"))
    return A.prediction_metrics(rows, ["model", "horizon"], F.col("label"), p)


@query(f"WITH {_PREDICTED} SELECT * REPLACE (round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(mean_probability, 6) AS mean_probability, round(binary_accuracy, 6) AS binary_accuracy) FROM a")
def prediction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses, accuracies and confusion of two models by horizon."""
    return rounded(_metrics(spark, sf_dir))


@query(
    f"""WITH {_PREDICTED} SELECT x.horizon, round(y.brier - x.brier, 6) AS brier_gain, round((y.brier - x.brier) / y.brier * 100, 6) AS brier_gain_pct, round(y.log_loss - x.log_loss, 6) AS log_loss_gain, round((y.log_loss - x.log_loss) / y.log_loss * 100, 6) AS log_loss_gain_pct,
  round(x.accuracy - y.accuracy, 6) AS accuracy_gain, round(x.mean_probability - y.mean_probability, 6) AS probability_gain FROM a x JOIN a y ON x.horizon = y.horizon AND x.model = 'other' AND y.model = 'plain'"""
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one model gains over the other in each horizon."""
    return rounded(A.metric_deltas(_metrics(spark, sf_dir), ["horizon"], "model", "plain", "other"))


@query(
    f"""WITH {_CASES}, v AS (SELECT horizon, change AS value FROM c), m AS (SELECT horizon, avg(value) AS mean, stddev_pop(value) AS dev, median(value) AS med FROM v GROUP BY horizon
), d AS (SELECT v.horizon, median(abs(value - med)) * 1.4826::DOUBLE AS mad FROM v JOIN m ON v.horizon = m.horizon GROUP BY v.horizon)
SELECT m.horizon, round(mean, 6) AS center, round(CASE WHEN dev > 1e-12 THEN dev ELSE 1 END, 6) AS scale, round(med, 6) AS robust_center, round(greatest(CASE WHEN mad > 1e-9 THEN mad ELSE dev END, 1e-9), 6) AS robust_scale FROM m JOIN d ON m.horizon = d.horizon"""
)
def feature_scalings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and robust scalings of a measure by horizon."""
    rows = cases(spark, sf_dir).select("horizon", F.col("change").alias("value"))
    robust = A.robust_scaling(rows, ["horizon"], "value").select("horizon", F.col("center").alias("robust_center"), F.col("scale").alias("robust_scale"))
    return rounded(A.standard_scaling(rows, ["horizon"], "value").join(robust, "horizon"))


@query(
    f"""WITH {_CASES}, f AS (SELECT {_ASK} AS ask, {_LABEL} AS label, {_SEEN[0]} AS fa, {_SEEN[1]} AS fb, open_ms FROM c
), a AS (SELECT ask, label, sqrt((least(36, (fa - first_value(fa) OVER d) ** 2) + least(36, (fb - first_value(fb) OVER d) ** 2)) / 2) AS dist FROM f WINDOW d AS (PARTITION BY ask ORDER BY open_ms)
), w AS (SELECT ask, greatest(max(dist), 0.25) AS w FROM a GROUP BY ask), s AS (SELECT a.ask, sum(CASE WHEN label = 'take_profit' THEN exp(-0.5::DOUBLE * (dist / w) ** 2) ELSE 0 END) AS t, sum(CASE WHEN label = 'stop_loss' THEN exp(-0.5::DOUBLE * (dist / w) ** 2) ELSE 0 END) AS l,
  sum(CASE WHEN label = 'expiry' THEN exp(-0.5::DOUBLE * (dist / w) ** 2) ELSE 0 END) AS e FROM a JOIN w ON a.ask = w.ask GROUP BY a.ask)
SELECT ask, round((t + 0.5) / (t + l + e + 1.5), 6) AS take_profit, round((l + 0.5) / (t + l + e + 1.5), 6) AS stop_loss, round((e + 0.5) / (t + l + e + 1.5), 6) AS expiry FROM s"""
)
def analog_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class probabilities of each symbol's day from its bars as analogs of the day's first one, with capped distances."""
    day = Window.partitionBy("ask").orderBy("open_ms")
    f = cases(spark, sf_dir).select(F.expr(_ASK).alias("ask"), F.expr(_LABEL).alias("label"), F.array(*map(F.expr, _SEEN)).alias("there"), "open_ms")
    rows = f.withColumn("here", F.first("there").over(day)).select("ask", "label", A.capped_distance(F.col("there"), F.col("here")).alias("dist"))
    return rounded(A.analog_probabilities(rows, "ask", "label", "dist"))


@query(
    f"""WITH {_CASES}, x AS (SELECT *, [hi, lo, mean20, prev] AS cs, [CAST(n_trades AS DOUBLE), volume, 4, NULL]::DOUBLE[] AS ns, entry * CASE WHEN side = 'long' THEN 0.75 ELSE 1.25 END::DOUBLE AS stop,
    entry * CASE WHEN side = 'long' THEN 1.25 ELSE 0.75 END::DOUBLE AS target, coalesce(next_close, entry) AS price FROM c
), y AS (SELECT *, list_filter([1, 2, 3, 4], lambda i: CASE WHEN side = 'short' THEN cs[i] > entry AND cs[i] <= stop ELSE cs[i] < entry AND cs[i] >= stop END) AS way, list_min([abs(c - price) for c in cs]) AS near, [entry, next_low, next_high, price] AS path FROM x
), z AS (SELECT *, list_position([abs(c - price) for c in cs], near) AS ni, list_max([coalesce(ns[i], 0) for i in way]) AS nm, nullif(coalesce(list_position([CASE WHEN side = 'long' THEN p >= target ELSE p <= target END for p in path], true), 0), 0) - 1 AS t, nullif(coalesce(list_position([CASE WHEN side = 'long' THEN p <= stop ELSE p >= stop END for p in path], true), 0), 0) - 1 AS a FROM y)
SELECT k, round(cs[ni], 6) AS nearest, CASE WHEN abs(cs[ni] - price) / price * 100 <= 1 THEN 'coincide' WHEN abs(cs[ni] - price) / price * 100 <= 2 THEN 'cercana' ELSE 'lejana' END AS proximity, round(cs[list_filter(way, lambda i: coalesce(ns[i], 0) = nm)[1]], 6) AS dominant,
  CASE WHEN t IS NULL AND a IS NULL THEN 'ninguno' WHEN a IS NULL THEN 'solo_objetivo' WHEN t IS NULL THEN 'solo_adverso' WHEN t < a THEN 'objetivo_primero' WHEN a < t THEN 'adverso_primero' ELSE 'mismo_punto' END AS first_touch,
  round((price - entry) / entry * 100, 6) AS variation_pct, round(margin * leverage * s * ((price - entry) / entry), 6) AS profit, CASE WHEN s * (price - stop) <= 0 THEN 'STOP LOSS' WHEN s * (price - target) >= 0 THEN 'TAKE PROFIT' ELSE 'ABIERTA' END AS state,
  CASE WHEN abs(price - entry) / entry * 100 <= 5 THEN 3 WHEN abs(price - entry) / entry * 100 <= 12 THEN 7 WHEN abs(price - entry) / entry * 100 <= 18 THEN 9 END AS crossed FROM z"""
)
def cluster_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and dominant clusters, path touches, trade states and frontier crossings of each case."""
    entry, long = F.col("entry"), F.col("side") == "long"
    cluster = lambda p, n: F.struct(F.col(p).alias("price"), n.cast("double").alias("notional"))
    clusters = F.array(cluster("hi", F.col("n_trades")), cluster("lo", F.col("volume")), cluster("mean20", F.lit(4)), cluster("prev", F.lit(None)))
    c = cases(spark, sf_dir).withColumns({"clusters": clusters, "stop": entry * F.when(long, 0.75).otherwise(1.25), "target": entry * F.when(long, 1.25).otherwise(0.75), "price": F.coalesce("next_close", entry)})
    path = F.array(entry, F.col("next_low"), F.col("next_high"), F.col("price"))
    nearest = A.nearest_cluster(F.col("clusters"), F.col("price"))["price"]
    state = A.trade_state(*[F.col(n) for n in ("side", "entry", "stop", "target", "margin", "leverage", "price")])
    frontier = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(step).alias("step")) for level, step in ((5.0, 3), (12.0, 7), (18.0, 9))])
    return rounded(
        c.select(
            "k",
            nearest.alias("nearest"),
            A.proximity(F.abs(nearest - F.col("price")) / F.col("price") * 100, F.lit(1.0)).alias("proximity"),
            A.cluster_before_stop(F.col("clusters"), entry, F.col("stop"), F.col("side"))["price"].alias("dominant"),
            A.first_touch_of(A.path_touch(path, F.col("side"), F.col("target"), False), A.path_touch(path, F.col("side"), F.col("stop"), True)).alias("first_touch"),
            state["variation_pct"].alias("variation_pct"),
            state["profit"].alias("profit"),
            state["state"].alias("state"),
            A.frontier_step(frontier, F.abs(F.col("price") - entry) / entry * 100).alias("crossed"),
        )
    )
