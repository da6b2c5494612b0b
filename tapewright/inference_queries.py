"""Clustered inference and budgeted samples over the plans of the event table, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _EVAL, DAY, labelled, query, rounded
from tapewright.fitting_queries import _FIT, FEATURES, fit_rows
from tapewright.functions import probability
from tapewright.operators import inference, statistics

WEEK = 7 * DAY
DRAWS = 200
_NUMBER = "('0x' || substr(md5({} || '/' || b || '/' || i), 1, 8))::BIGINT"

_INFER = (
    _FIT.split(", cut AS (")[0]
    + """, r AS (SELECT feature, round(score, 9) AS s, pos, at_ms // 604800000 AS week FROM (
    SELECT 'movement/' || name AS feature, CASE name WHEN 'directional_efficiency' THEN f1 WHEN 'log_sigma' THEN f2 ELSE f3 END AS score, label <> 'expiry' AS pos, at_ms FROM all_rows, (SELECT unnest(['directional_efficiency', 'log_sigma', 'log_volume']) AS name)
    UNION ALL SELECT 'direction/' || name, CASE name WHEN 'directional_efficiency' THEN f1 WHEN 'log_sigma' THEN f2 ELSE f3 END, label = 'take_profit', at_ms FROM all_rows, (SELECT unnest(['directional_efficiency', 'log_sigma', 'log_volume']) AS name) WHERE label <> 'expiry')), wk AS (
  SELECT week, row_number() OVER (ORDER BY week) - 1 AS c, count(*) OVER () AS m FROM (SELECT DISTINCT week FROM r)), rc AS (SELECT feature, s, pos, c, m FROM r JOIN wk USING (week)), tot AS (
  SELECT feature, count(*) FILTER (pos) AS np, count(*) FILTER (NOT pos) AS nn, count(DISTINCT s) AS ns, any_value(m) AS m FROM rc GROUP BY feature), ok AS (
  SELECT *, CASE WHEN np + nn < 50 OR np < 10 OR nn < 10 THEN 'insufficient' WHEN ns < 2 THEN 'constant' ELSE 'quantified' END AS status FROM tot), g AS (
  SELECT feature, s, pos, c, count(*) AS k FROM rc GROUP BY ALL), v AS MATERIALIZED (
  SELECT feature, x.pos AS xp, x.c AS xc, y.pos AS yp, y.c AS yc, sum(x.k * y.k * CASE WHEN x.s > y.s THEN 1.0::DOUBLE WHEN x.s = y.s THEN 0.5::DOUBLE ELSE 0 END) AS wins, sum(x.k * y.k) AS pairs
  FROM g x JOIN g y USING (feature) JOIN ok USING (feature) WHERE status = 'quantified' GROUP BY ALL), whole AS (
  SELECT feature, sum(wins) / sum(pairs) AS auc, sum(wins) FILTER (xc < e AND yc < e) / sum(pairs) FILTER (xc < e AND yc < e) AS early_auc, sum(wins) FILTER (xc >= e AND yc >= e) / sum(pairs) FILTER (xc >= e AND yc >= e) AS latest_auc
  FROM v JOIN (SELECT feature, greatest(1, floor(m * 0.7::DOUBLE)) AS e FROM tot) USING (feature) WHERE xp AND NOT yp GROUP BY feature), draws AS (SELECT b FROM (SELECT unnest(range(0, 200)) AS b)), w AS (
  SELECT b, """ + _NUMBER.format("'7'") + """ % m AS c, count(*) AS w FROM draws, (SELECT DISTINCT m FROM wk), unnest(range(0, m)) AS t(i) GROUP BY 1, 2), boot AS (
  SELECT feature, a.b, sum(wins * a.w * z.w) / sum(pairs * a.w * z.w) AS auc FROM v JOIN w a ON a.c = xc JOIN w z ON z.c = yc AND z.b = a.b WHERE xp AND NOT yp GROUP BY feature, a.b HAVING sum(pairs * a.w * z.w) > 0), ci AS (
  SELECT feature, CASE WHEN count(*) >= 160 THEN list_sort(list(auc))[CAST(floor(0.025::DOUBLE * (count(*) - 1)) AS INT) + 1] END AS low, CASE WHEN count(*) >= 160 THEN list_sort(list(auc))[CAST(floor(0.975::DOUBLE * (count(*) - 1)) AS INT) + 1] END AS high FROM boot GROUP BY feature), fl AS (
  SELECT b, i AS c, """ + _NUMBER.format("'8'") + """ % 2 = 1 AS f FROM draws, (SELECT DISTINCT m FROM wk), unnest(range(0, m)) AS t(i)), perm AS (
  SELECT feature, a.b, sum(wins) / sum(pairs) AS auc FROM v JOIN fl a ON a.c = xc AND xp <> a.f JOIN fl z ON z.c = yc AND z.b = a.b AND yp = z.f GROUP BY feature, a.b), pv AS (
  SELECT feature, (count(*) FILTER (abs(perm.auc - 0.5) >= abs(whole.auc - 0.5) - 1e-12) + 1) / 201.0::DOUBLE AS p FROM perm JOIN whole USING (feature) GROUP BY feature), res AS (
  SELECT feature, np AS n_positive, nn AS n_negative, status, auc, low, high, early_auc, latest_auc, p FROM ok LEFT JOIN whole USING (feature) LEFT JOIN ci USING (feature) LEFT JOIN pv USING (feature)), ranked AS (
  SELECT feature, p, row_number() OVER (ORDER BY p, feature) AS rk, count(*) OVER () AS mm FROM res WHERE p IS NOT NULL), adj AS (
  SELECT feature, min(least(1, p * mm / rk)) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM ranked)"""
)


@query(f"WITH RECURSIVE {_INFER} SELECT feature, n_positive, n_negative, status, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("auc", "low", "high", "early_auc", "latest_auc", "p", "q")) + " FROM res LEFT JOIN adj USING (feature)")
def feature_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether features tell movement (any barrier touched) and direction (target before stop): AUC, intervals and p by weeks, adjusted for their number."""
    plans = fit_rows(spark, sf_dir).withColumn("week", F.expr(f"at_ms div {WEEK}"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), F.lit(n).alias("name"), F.round(n, 9).alias("score")) for t in ("movement", "direction") for n in FEATURES])).alias("e")
    rows = plans.select("label", "week", each).select("label", "week", "e.*").where("target = 'movement' or label <> 'expiry'")
    hit = F.when(F.col("target") == "movement", F.col("label") != "expiry").otherwise(F.col("label") == "take_profit")
    found = inference.cluster_auc(rows.withColumn("feature", F.concat_ws("/", "target", "name")), "feature", "score", hit, "week", 7, DRAWS)
    adjusted = statistics.benjamini_hochberg(found.where("p is not null"), "feature", "p").select("feature", "q")
    return rounded(found.join(adjusted, "feature", "left"))


_TEMPERED = ", ".join(f"greatest({p}, 1e-15) ** (1 / t) AS r{i}" for i, p in enumerate(("p_tp", "p_sl", "p_expiry")))
_IMPROVED = (
    _EVAL
    + f""", lp AS (SELECT scored.plan_id, scored.symbol, pl.at_ms // 604800000 AS week, label, round(p_tp, 9) AS p_tp, round(p_sl, 9) AS p_sl, round(p_expiry, 9) AS p_expiry FROM scored JOIN pl USING (plan_id)), t AS (
  SELECT *, 'tempered ' || t AS model, {_TEMPERED} FROM lp, (SELECT unnest([0.7, 1.5]::DOUBLE[]) AS t)), n AS (
  SELECT *, r0 / (r0 + r1 + r2) AS q0, r1 / (r0 + r1 + r2) AS q1, r2 / (r0 + r1 + r2) AS q2 FROM t), d AS (
  SELECT model, symbol || '/' || week AS episode,
    -ln(greatest(CASE label WHEN 'take_profit' THEN p_tp WHEN 'stop_loss' THEN p_sl ELSE p_expiry END, 1e-15)) + ln(greatest(CASE label WHEN 'take_profit' THEN q0 WHEN 'stop_loss' THEN q1 ELSE q2 END, 1e-15)) AS log_loss,
    (p_tp - (label = 'take_profit')::INT) ** 2 + (p_sl - (label = 'stop_loss')::INT) ** 2 + (p_expiry - (label = 'expiry')::INT) ** 2
      - (q0 - (label = 'take_profit')::INT) ** 2 - (q1 - (label = 'stop_loss')::INT) ** 2 - (q2 - (label = 'expiry')::INT) ** 2 AS brier FROM n), ep AS (
  SELECT model, episode, avg(log_loss) AS log_loss, avg(brier) AS brier, row_number() OVER (PARTITION BY model ORDER BY episode) - 1 AS i, count(*) OVER (PARTITION BY model) AS m FROM d GROUP BY model, episode), st AS (
  SELECT model, count(*) AS clusters, avg(log_loss) AS mean_log_loss, avg(brier) AS mean_brier, avg(log_loss) / (stddev_samp(log_loss) / sqrt(count(*))) AS z_log_loss, avg(brier) / (stddev_samp(brier) / sqrt(count(*))) AS z_brier FROM ep GROUP BY model), picks AS (
  SELECT model, b, {_NUMBER.format("'7'")} % m AS i FROM ep, (SELECT unnest(range(0, 200)) AS b)), bm AS (
  SELECT model, b, avg(log_loss) AS log_loss, avg(brier) AS brier FROM picks JOIN ep USING (model, i) GROUP BY model, b), ci AS (
  SELECT model, list_sort(list(log_loss)) AS l, list_sort(list(brier)) AS h FROM bm GROUP BY model), out_ AS (
  SELECT st.*, CASE WHEN clusters >= 20 THEN l[CAST(floor(0.025::DOUBLE * 199) AS INT) + 1] END AS low_log_loss, CASE WHEN clusters >= 20 THEN l[CAST(floor(0.975::DOUBLE * 199) AS INT) + 1] END AS high_log_loss,
         CASE WHEN clusters >= 20 THEN h[CAST(floor(0.025::DOUBLE * 199) AS INT) + 1] END AS low_brier, CASE WHEN clusters >= 20 THEN h[CAST(floor(0.975::DOUBLE * 199) AS INT) + 1] END AS high_brier FROM st JOIN ci USING (model))"""
)
# 1 - cdf by the series in gammas: 1 / (2n + 1)!! = sqrt(pi) / (2 ** (n + 1) * gamma(n + 3 / 2))
_TAIL = "CASE WHEN abs({z}) >= 9 THEN CASE WHEN {z} > 0 THEN 0 ELSE 1 END ELSE 0.5 - sign({z}) * least(0.5, exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 161), lambda k: exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) + ln(sqrt(pi())) - (k + 1) * ln(2) - lgamma(k + 1.5))))) END"


@query(
    f"WITH {_IMPROVED} SELECT model, clusters, "
    + ", ".join(f"round({s}_{v}, 5) + 0.0 AS {s}_{v}" for v in ("log_loss", "brier") for s in ("mean", "low", "high"))
    + ", "
    + ", ".join(f"round({_TAIL.format(z=f'z_{v}')}, 5) AS p_{v}" for v in ("log_loss", "brier"))
    + " FROM out_"
)
def improvement_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sharpened and softened first-passage probabilities gain over plain ones, by episodes (a symbol's week)."""
    plans = labelled(spark, sf_dir).drop("brier", "log_loss").withColumns({p: F.round(p, 9) for p in ("p_tp", "p_sl", "p_expiry")})
    plain = statistics.losses(plans).withColumnsRenamed({"brier": "plain_brier", "log_loss": "plain_log_loss"})
    out = None
    for t in (0.7, 1.5):
        moved = plain.withColumns(dict(zip(("p_tp", "p_sl", "p_expiry"), probability.tempered([F.col(p) for p in ("p_tp", "p_sl", "p_expiry")], t), strict=True)))
        own = statistics.losses(moved).select(F.lit(f"tempered {t}").alias("model"), F.concat_ws("/", "symbol", F.expr(f"at_ms div {WEEK}").cast("string")).alias("episode"), (F.col("plain_log_loss") - F.col("log_loss")).alias("log_loss"), (F.col("plain_brier") - F.col("brier")).alias("brier"))
        out = own if out is None else out.unionByName(own)
    return rounded(inference.improvements(out, "model", "episode", ["log_loss", "brier"], 7, DRAWS), 5)


@query(
    """WITH RECURSIVE eps AS (SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS episode, count(*) AS n FROM events GROUP BY 1), o AS (
  SELECT episode, n, row_number() OVER (ORDER BY md5('7/' || episode), episode) AS i, (SELECT count(*) // 3 FROM events) AS budget FROM eps), walk AS (
  SELECT i, episode, n, budget, n AS total, true AS taken FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.episode, o.n, o.budget, CASE WHEN total + o.n <= o.budget THEN total + o.n ELSE total END, total + o.n <= o.budget FROM walk JOIN o ON o.i = walk.i + 1)
SELECT episode, n FROM walk WHERE taken"""
)
def episode_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole episodes (an event type's day) in the order of their digests, under a budget of a third of all events: the sample is the feature."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    episodes = events.groupBy(F.concat_ws("/", "event_type", F.to_date("ts").cast("string")).alias("episode")).agg(F.count("*").alias("n"))
    return inference.admitted_groups(episodes, "episode", "n", events.count() // 3, 7, 32)
