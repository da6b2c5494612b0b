"""Fitted models over the plans of the event table, with their SQL twins (the optimiser as a recursive query)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _EVAL, DAY, HOUR, hourly, moved_plans, query, rounded, with_first_passage
from tapewright.functions import probability
from tapewright.operators import fitting, outcomes
from tapewright.storage import stored

#: What the offsets are linear in: efficiency towards the target, and the logarithms of deviation and volume.
FEATURES = ("directional_efficiency", "log_sigma", "log_volume")
#: The part of the plans' time that models are fitted on; ridges are chosen on the rest.
DEVELOPMENT = 0.6
#: Hours of the horizons that a ridge is judged by.
HORIZONS = (4, 12, 24)


def features() -> dict[str, Column]:
    toward = F.when(F.col("side") == "long", F.col("efficiency")).otherwise(-F.col("efficiency"))
    return {"directional_efficiency": toward, "log_sigma": F.ln("sigma"), "log_volume": F.ln(1 + F.col("horizon_volume"))}


def fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled plans with probabilities for the whole day, features, and label_ms (when the label was known to hold)."""
    bars = stored(hourly(spark, sf_dir), "bars")
    plans = with_first_passage(moved_plans(bars)).withColumns(features())
    # digits below 1e-9 are rounding errors of the series, but would count in the logarithm of a probability near 0
    plans = plans.withColumns({p: F.round(p, 9) for p in fitting.PROBABILITIES})
    keep = ("symbol", "at_ms", "side", "up", "down", "sigma", "p_tp", "p_sl", "p_expiry", *FEATURES)
    return stored(outcomes.first_touch(plans, bars, DAY, keep).where("label not in ('ambiguous', 'unresolved')"), "fit-plans")


def divided(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans up to a share of the time that they span, and the later ones."""
    low, high = rows.agg(F.min("at_ms"), F.max("at_ms")).first()
    cut = 0 if low is None else low + int((high - low) * DEVELOPMENT)
    return rows.where(F.col("at_ms") <= cut), rows.where(F.col("at_ms") > cut)


_FIT = (
    _EVAL
    + """, all_rows AS (
  SELECT ev.plan_id, pl.at_ms, label, round(p_tp, 9) AS p_tp, round(p_sl, 9) AS p_sl, round(p_expiry, 9) AS p_expiry, sqrt(rv) AS sigma, ev.side,
         CASE WHEN ev.side = 'long' THEN 1 ELSE -1 END * CASE WHEN var > 0 THEN disp / var END AS f1, ln(sqrt(rv)) AS f2, ln(1 + hv) AS f3
  FROM ev JOIN pl USING (plan_id) JOIN feats ON ev.plan_id = feats.symbol || '/' || feats.open_ms), cut AS (
  SELECT min(at_ms) + CAST(floor((max(at_ms) - min(at_ms)) * 0.6::DOUBLE) AS BIGINT) AS cut FROM all_rows), dev AS (
  SELECT all_rows.* FROM all_rows, cut WHERE at_ms <= cut), sc AS (
  SELECT count(*) AS n, avg(f1) AS m1, avg(f2) AS m2, avg(f3) AS m3, greatest(stddev_pop(f1), 1e-12) AS s1, greatest(stddev_pop(f2), 1e-12) AS s2, greatest(stddev_pop(f3), 1e-12) AS s3 FROM dev), x AS MATERIALIZED (
  SELECT p_tp, p_sl, p_expiry, (label = 'take_profit')::INT AS y1, (label = 'stop_loss')::INT AS y2, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2, (f3 - m3) / s3 AS z3, n FROM dev, sc), steps AS (
  SELECT 0 AS i, ridge, list_transform(range(8), lambda k: 0.0::DOUBLE) AS c, list_transform(range(8), lambda k: 0.0::DOUBLE) AS m, list_transform(range(8), lambda k: 0.0::DOUBLE) AS v
  FROM (SELECT unnest([0.1, 1.0, 10.0]::DOUBLE[]) AS ridge)
  UNION ALL
  SELECT i + 1, ridge, list_transform(range(1, 9), lambda k: c[k] - 0.03::DOUBLE * (m1[k] / (1 - pow(0.9::DOUBLE, i + 1))) / (sqrt(v1[k] / (1 - pow(0.999::DOUBLE, i + 1))) + 1e-8::DOUBLE)), m1, v1 FROM (
    SELECT *, list_transform(range(1, 9), lambda k: 0.9::DOUBLE * m[k] + 0.1::DOUBLE * g[k]) AS m1, list_transform(range(1, 9), lambda k: 0.999::DOUBLE * v[k] + 0.001::DOUBLE * g[k] * g[k]) AS v1 FROM (
      SELECT i, ridge, c, m, v, list_transform(range(1, 9), lambda k: greatest(-10, least(10, gs[k] / n + CASE WHEN k IN (1, 5) THEN 0 ELSE ridge * c[k] / n END))) AS g FROM (
        SELECT i, ridge, any_value(c) AS c, any_value(m) AS m, any_value(v) AS v, any_value(n) AS n,
               [sum(q1 - y1), sum((q1 - y1) * z1), sum((q1 - y1) * z2), sum((q1 - y1) * z3), sum(q2 - y2), sum((q2 - y2) * z1), sum((q2 - y2) * z2), sum((q2 - y2) * z3)] AS gs FROM (
          SELECT *, e1 / (e1 + e2 + e3) AS q1, e2 / (e1 + e2 + e3) AS q2 FROM (
            SELECT s.*, x.*, greatest(p_tp, 1e-15) * exp(c[1] + c[2] * z1 + c[3] * z2 + c[4] * z3) AS e1, greatest(p_sl, 1e-15) * exp(c[5] + c[6] * z1 + c[7] * z2 + c[8] * z3) AS e2, greatest(p_expiry, 1e-15) AS e3
            FROM steps s, x WHERE i < 80))
        GROUP BY i, ridge)))), fitted AS (SELECT * FROM steps WHERE i = 80)"""
)


@query(
    f"""WITH RECURSIVE {_FIT} SELECT ridge, cause, name, round(c[k] + 0.0, 5) AS coefficient FROM fitted, (
  SELECT unnest(range(1, 9)) AS k, unnest(['take_profit', 'take_profit', 'take_profit', 'take_profit', 'stop_loss', 'stop_loss', 'stop_loss', 'stop_loss']) AS cause,
         unnest(['intercept', 'directional_efficiency', 'log_sigma', 'log_volume', 'intercept', 'directional_efficiency', 'log_sigma', 'log_volume']) AS name)"""
)
def fitted_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-odds offsets to first-passage probabilities, fitted on the earlier plans for every ridge at once."""
    rows, _ = divided(fit_rows(spark, sf_dir))
    return rounded(fitting.fit_softmax_offset(rows, list(FEATURES)).table(rows), 5)


_SCORED = (
    _FIT
    + """, later AS (
  SELECT all_rows.*, (f1 - m1) / s1 AS z1, (f2 - m2) / s2 AS z2, (f3 - m3) / s3 AS z3 FROM all_rows, cut, sc WHERE at_ms > cut), firsts AS (
  SELECT plan_id, arg_min(CASE WHEN s AND t THEN 'ambiguous' WHEN s THEN 'stop_loss' ELSE 'take_profit' END, close_ms) FILTER (s OR t) AS label, min(close_ms) FILTER (s OR t) AS touch_ms FROM hits GROUP BY plan_id), cases AS (
  SELECT later.*, h, CASE WHEN touch_ms <= at_ms + h * 3600000 THEN firsts.label ELSE 'expiry' END AS own FROM later JOIN firsts USING (plan_id), (SELECT unnest([4, 12, 24]) AS h)), shifted AS (
  SELECT ridge, h, own, greatest(p_tp, 1e-15) * exp(c[1] + c[2] * z1 + c[3] * z2 + c[4] * z3) AS e1, greatest(p_sl, 1e-15) * exp(c[5] + c[6] * z1 + c[7] * z2 + c[8] * z3) AS e2, greatest(p_expiry, 1e-15) AS e3
  FROM (SELECT cases.* REPLACE (round(q.p_tp, 9) AS p_tp, round(q.p_sl, 9) AS p_sl, round(q.p_expiry, 9) AS p_expiry) FROM cases JOIN staged q USING (plan_id, h)), fitted), each AS (
  SELECT ridge, h, own, e1 / (e1 + e2 + e3) AS p1, e2 / (e1 + e2 + e3) AS p2, e3 / (e1 + e2 + e3) AS p3 FROM shifted), by_h AS (
  SELECT ridge, h, count(*) AS n, avg(-ln(greatest(CASE own WHEN 'take_profit' THEN p1 WHEN 'stop_loss' THEN p2 ELSE p3 END, 1e-15))) AS log_loss,
         avg((p1 - (own = 'take_profit')::INT) ** 2 + (p2 - (own = 'stop_loss')::INT) ** 2 + (p3 - (own = 'expiry')::INT) ** 2) AS brier FROM each GROUP BY ridge, h), scores AS (
  SELECT ridge, CAST(sum(n) AS BIGINT) AS n, avg(log_loss) AS log_loss, avg(brier) AS brier FROM by_h GROUP BY ridge)"""
).replace(
    ", shifted AS (",
    """, staged AS (
  SELECT plan_id, h, least(1, greatest(0, b / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: CASE WHEN n % 2 = 1 THEN 1 ELSE -1 END * sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_tp,
         least(1, greatest(0, a / (a + b) - 2 / pi() * list_sum(list_transform(range(1, terms + 1), lambda n: sin(n * pi() * b / (a + b)) * exp(-decay * n * n) / n)))) AS p_sl,
         least(1, greatest(0, 1 - p_tp - p_sl)) AS p_expiry
  FROM (SELECT plan_id, h, a, b, pi() * pi() / 2 * sg * sg / ((a + b) * (a + b)) AS decay, greatest(8, ceil(sqrt(31.0 / (pi() * pi() / 2 * sg * sg / ((a + b) * (a + b))))))::INT AS terms
        FROM (SELECT plan_id, h, a, b, sigma * sqrt(h / 24.0::DOUBLE) AS sg FROM geo, (SELECT unnest([4, 12, 24]) AS h)))), shifted AS (""",
    1,
)


@query(f"WITH RECURSIVE {_SCORED} SELECT ridge, n, round(log_loss, 5) AS log_loss, round(brier, 5) AS brier, ridge = first_value(ridge) OVER (ORDER BY log_loss, brier, ridge) AS selected FROM scores")
def ridge_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ridge judged on the later plans, over several horizons."""
    early, later = divided(fit_rows(spark, sf_dir))
    fit = fitting.fit_softmax_offset(early, list(FEATURES))
    horizon = F.explode(F.array(*map(F.lit, HORIZONS)))
    cases = later.withColumn("horizon", horizon).withColumn("label", F.when(F.col("touch_ms") <= F.col("at_ms") + F.col("horizon") * HOUR, F.col("label")).otherwise("expiry"))
    staged = probability.double_barrier(F.col("up"), F.col("down"), F.col("sigma"), F.col("horizon") / 24.0)
    cases = cases.withColumn("_p", staged).withColumns({p: F.round(f"_p.{p}", 9) for p in fitting.PROBABILITIES})
    return rounded(fitting.ridge_scores(fit, cases, "horizon"), 5)
