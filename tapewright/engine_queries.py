"""Stage contexts and the sequential and empirical engines over the plans of the event table, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _CHANGES, DAY, HOUR, hourly, moved_plans, plans_of, query, rounded, with_first_passage
from tapewright.functions import scalars
from tapewright.operators import analogs, engines, outcomes, stages
from tapewright.storage import stored

SCALES = stages.SCALES
PARTS = ("sigma", "efficiency", "place", "activity")

_STAGES = _CHANGES + ", st AS (SELECT symbol, open_ms, n, close, close_ms, " + ", ".join(
    f"""sqrt(sum(ret * ret) OVER w{s}) AS sigma_{n}, CASE WHEN sum(abs(ret)) OVER w{s} > 0 THEN sum(ret) OVER w{s} / sum(abs(ret)) OVER w{s} ELSE 0 END AS efficiency_{n},
  CASE WHEN max(high) OVER w{s} > min(low) OVER w{s} THEN (close - min(low) OVER w{s}) / (max(high) OVER w{s} - min(low) OVER w{s}) ELSE 0.5 END AS place_{n},
  ln((sum(volume) OVER w{s} / {s}) / (sum(volume) OVER w168 / 168)) AS activity_{n}, max(high) OVER w{s} AS high_{n}, min(low) OVER w{s} AS low_{n}"""
    for n, s in SCALES.items()
) + " FROM ch WINDOW " + ", ".join(f"w{s} AS (PARTITION BY symbol ORDER BY open_ms ROWS {s - 1} PRECEDING)" for s in SCALES.values()) + "), ctx AS (SELECT * FROM st WHERE n > 168)"


def _long(c: str) -> str:
    return f"CASE WHEN (open_ms // 3600000) % 2 = 0 THEN {c[0]} ELSE {c[1]} END" if isinstance(c, tuple) else c


_CTX_PLANS = (
    _STAGES
    + """, cp AS (SELECT symbol || '/' || open_ms AS plan_id, close_ms AS at_ms, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 'long' ELSE 'short' END AS side,
  CASE WHEN (open_ms // 3600000) % 2 = 0 THEN ln(1.5) ELSE ln(1 / 0.9::DOUBLE) END AS up, CASE WHEN (open_ms // 3600000) % 2 = 0 THEN ln(1 / 0.9::DOUBLE) ELSE ln(1.5) END AS down,
  CASE WHEN (open_ms // 3600000) % 2 = 0 THEN close * 1.5::DOUBLE ELSE close * 0.9::DOUBLE END AS target, * FROM ctx)"""
)


def context_plans(bars: DataFrame) -> DataFrame:
    """Plans of bars with a full week behind them, with the contexts of every scale."""
    names = tuple(f"{p}_{n}" for n in SCALES for p in (*PARTS, "high", "low"))
    plans = plans_of(stages.contexts(bars, keep=("close_ms",)), ("n", *names))
    up, down = scalars.log_distances(F.col("side"), F.col("entry"), F.col("stop"), F.col("target"))
    return plans.withColumns({"up": up, "down": down})


@query(
    f"WITH {_CTX_PLANS} SELECT plan_id, "
    + ", ".join(f"round({p}_{n}, 6) AS {p}_{n}" for n in SCALES for p in PARTS)
    + ", "
    + ", ".join(f"CASE WHEN side = 'long' THEN close < high_{n} AND high_{n} < target ELSE target < low_{n} AND low_{n} < close END AS between_{n}" for n in SCALES)
    + " FROM cp"
)
def stage_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan's contexts at three scales, and whether a scale's extreme stands between entry and target."""
    plans = context_plans(hourly(spark, sf_dir))
    between = [stages.target_between(F.col("side"), F.col("entry"), F.col("target"), F.col(f"high_{n}"), F.col(f"low_{n}")).alias(f"between_{n}") for n in SCALES]
    return rounded(plans.select("plan_id", *[f"{p}_{n}" for n in SCALES for p in PARTS], *between))


#: Coefficient, mean and deviation of the features of each stage's model, by cause; the last stage keeps its baseline.
MODELS = {
    "4h": {"tp": {"intercept": (0.1, 0.0, 1.0), "efficiency_4h": (0.3, 0.0, 0.5)}, "sl": {"intercept": (-0.05, 0.0, 1.0), "activity_4h": (0.2, 0.0, 0.4)}},
    "24h": {"tp": {"efficiency_24h": (0.2, 0.0, 0.3), "place_4h": (-0.1, 0.5, 0.3)}, "sl": {"place_24h": (0.15, 0.5, 0.3)}},
}


def _series(up: str, down: str, var: str) -> str:
    """First-passage probabilities of a variance, as a struct."""
    terms = f"greatest(8, ceil(sqrt(31.0 / (pi() * pi() / 2 * {var} / (({up} + {down}) * ({up} + {down}))))))::INT"
    tail = f"sin(k * pi() * {down} / ({up} + {down})) * exp(-(pi() * pi() / 2 * {var} / (({up} + {down}) * ({up} + {down}))) * k * k) / k"
    p_tp = f"least(1, greatest(0, {down} / ({up} + {down}) - 2 / pi() * list_sum(list_transform(range(1, {terms} + 1), lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * {tail}))))"
    p_sl = f"least(1, greatest(0, {up} / ({up} + {down}) - 2 / pi() * list_sum(list_transform(range(1, {terms} + 1), lambda k: {tail}))))"
    return f"{{'tp': {p_tp}, 'sl': {p_sl}}}"


def _offset(stage: str, cause: str) -> str:
    return " + ".join(["0.0::DOUBLE", *[f"{c}::DOUBLE" if f == "intercept" else f"{c}::DOUBLE * ({f} - {m}::DOUBLE) / {s}::DOUBLE" for f, (c, m, s) in MODELS.get(stage, {}).get(cause, {}).items()]])


_SEQ = (
    _CTX_PLANS
    + ", v AS (SELECT *, sigma_4h ** 2 AS v1, sigma_4h ** 2 + sigma_24h ** 2 * (20 / 24::DOUBLE) AS v2, sigma_4h ** 2 + sigma_24h ** 2 * (20 / 24::DOUBLE) + sigma_7d ** 2 * (144 / 168::DOUBLE) AS v3 FROM cp)"
    + f", b AS (SELECT *, {_series('up', 'down', 'v1')} AS b1, {_series('up', 'down', 'v2')} AS b2, {_series('up', 'down', 'v3')} AS b3 FROM v WHERE v1 > 0)"
    + """, a AS (SELECT *, greatest(0, 1 - b1.tp - b1.sl) AS n1, greatest(0, 1 - b2.tp - b2.sl) AS n2, greatest(0, 1 - b3.tp - b3.sl) AS n3 FROM b), q AS (
  SELECT *, [b1.tp, b1.sl, n1] AS r1, [greatest(0, b2.tp - b1.tp) / n1, greatest(0, b2.sl - b1.sl) / n1, n2 / n1] AS r2, [greatest(0, b3.tp - b2.tp) / n2, greatest(0, b3.sl - b2.sl) / n2, n3 / n2] AS r3 FROM a), c AS (
  SELECT *, list_transform(r1, lambda x: x / list_sum(r1)) AS c1, CASE WHEN n1 <= 1e-12 THEN [0, 0, 1]::DOUBLE[] ELSE list_transform(r2, lambda x: x / list_sum(r2)) END AS c2,
         CASE WHEN n2 <= 1e-12 THEN [0, 0, 1]::DOUBLE[] ELSE list_transform(r3, lambda x: x / list_sum(r3)) END AS c3 FROM q)"""
    + f""", m AS (SELECT *, [greatest(c1[1], 1e-15) * exp({_offset('4h', 'tp')}), greatest(c1[2], 1e-15) * exp({_offset('4h', 'sl')}), greatest(c1[3], 1e-15)] AS m1,
  [greatest(c2[1], 1e-15) * exp({_offset('24h', 'tp')}), greatest(c2[2], 1e-15) * exp({_offset('24h', 'sl')}), greatest(c2[3], 1e-15)] AS m2 FROM c), s AS (
  SELECT plan_id, list_transform(m1, lambda x: x / list_sum(m1)) AS p1, list_transform(m2, lambda x: x / list_sum(m2)) AS p2, c3 AS p3 FROM m), k AS (
  SELECT *, p1[1] AS tp_4h, p1[2] AS sl_4h, 1 - p1[1] - p1[2] AS none_4h FROM s), k2 AS (
  SELECT *, tp_4h + none_4h * p2[1] AS tp_24h, sl_4h + none_4h * p2[2] AS sl_24h FROM k), k3 AS (SELECT *, 1 - tp_24h - sl_24h AS none_24h FROM k2), k4 AS (
  SELECT *, tp_24h + none_24h * p3[1] AS tp_7d, sl_24h + none_24h * p3[2] AS sl_7d FROM k3)"""
)


@query(f"WITH {_SEQ} SELECT plan_id, " + ", ".join(f"round({p}_{n}, 6) + 0.0 AS {p}_{n}" for n in SCALES for p in ("tp", "sl")) + " FROM k4")
def sequential_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-touch probabilities of every plan up to 4 hours, a day and a week, by chained conditional stages."""
    out = stages.sequential(context_plans(hourly(spark, sf_dir)).where("sigma_4h > 0"), MODELS)
    return rounded(out.select("plan_id", *[f"{p}_{n}" for n in SCALES for p in ("tp", "sl")]))


# ---- empirical engine

#: Hours after which a stage begins and ends.
BOUNDS = {"4h": (0, 4), "24h": (4, 24), "7d": (24, 168)}
#: Centre and scale of the features of every stage; directions are taken towards the target.
SCALING = {"efficiency": (0.0, 0.5), "place": (0.5, 0.3), "sigma": (-2.5, 0.8), "activity": (0.0, 0.5)}


def oriented(n: str, long: F.Column | None = None) -> list:
    """A scale's standardised features, as seen by a long plan where the condition holds, else by a short one."""
    sign = F.when(long, 1.0).otherwise(-1.0)
    place = F.when(long, F.col(f"place_{n}")).otherwise(1 - F.col(f"place_{n}"))
    raw = {"efficiency": sign * F.col(f"efficiency_{n}"), "place": place, "sigma": F.ln(f"sigma_{n}"), "activity": F.col(f"activity_{n}")}
    return [(raw[k] - c) / s for k, (c, s) in SCALING.items()]


def empirical_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The empirical engine for every 24th plan (the stated query set) against all earlier bars, seen both as long and as short."""
    bars = stored(hourly(spark, sf_dir), "bars")
    plans = stored(context_plans(bars).where("sigma_4h > 0"), "context-plans")
    both = plans.withColumn("orientation", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("row_id", F.concat_ws("/", "plan_id", F.col("orientation").cast("string")))
    names, so_far = list(BOUNDS), []
    trees, vectors = {}, {}
    for n in names:
        so_far = [*so_far, n]
        seen = F.array(*[x for m in so_far for x in oriented(m, F.col("orientation") == 0)])
        vectors[n] = F.array(*[x for m in so_far for x in oriented(m, F.col("side") == "long")])
        trees[n] = analogs.Boxes(both.select("row_id", "symbol", "at_ms", seen.alias("v")), 4 * len(so_far))
    steps = outcomes.frontiers(plans, bars, 7 * DAY, HOUR)
    rising = lambda d: F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("level", "step"))))
    known = steps.groupBy("plan_id").agg(rising("up").alias("up_frontier"), rising("down").alias("down_frontier"))
    none = F.array().cast("array<struct<level:double,step:int>>")
    paths = both.select("plan_id", "row_id", "orientation").join(known, "plan_id", "left").select(
        "row_id",
        F.coalesce(F.when(F.col("orientation") == 0, F.col("up_frontier")).otherwise(F.col("down_frontier")), none).alias("favourable"),
        F.coalesce(F.when(F.col("orientation") == 0, F.col("down_frontier")).otherwise(F.col("up_frontier")), none).alias("adverse"),
    )
    asked = plans.where("n % 24 = 0").select(F.col("plan_id").alias("query_id"), "symbol", "at_ms", "up", "down", *[v.alias(f"v_{n}") for n, v in vectors.items()])
    return engines.empirical(stored(asked, "engine-asked"), trees, stored(paths, "engine-paths"), BOUNDS)


def _oriented_sql(n: str, long: str) -> list[str]:
    return [
        f"(CASE WHEN {long} THEN 1 ELSE -1 END * efficiency_{n} - 0.0::DOUBLE) / 0.5::DOUBLE",
        f"(CASE WHEN {long} THEN place_{n} ELSE 1 - place_{n} END - 0.5::DOUBLE) / 0.3::DOUBLE",
        f"(ln(sigma_{n}) + 2.5::DOUBLE) / 0.8::DOUBLE",
        f"(activity_{n} - 0.0::DOUBLE) / 0.5::DOUBLE",
    ]


_EMP = _CTX_PLANS + """, good AS (SELECT * FROM cp WHERE sigma_4h > 0), fw AS (
  SELECT p.plan_id, CAST(ceil((b.close_ms - p.at_ms) / 3600000.0::DOUBLE) AS INT) AS step, ln(b.high / p.close) AS u, ln(p.close / b.low) AS d
  FROM good p JOIN bars b ON p.symbol = b.symbol AND b.close_ms > p.at_ms AND b.close_ms <= p.at_ms + 604800000), rows_ AS (
  SELECT plan_id || '/' || o AS row_id, plan_id, o, symbol, at_ms, """ + ", ".join(f"[{', '.join(_oriented_sql(n, 'o = 0'))}] AS f_{n}" for n in BOUNDS) + """ FROM good, (SELECT unnest([0, 1]) AS o)), asked AS (
  SELECT plan_id AS query_id, symbol, at_ms, up, down, """ + ", ".join("[" + ", ".join(_oriented_sql(n, "side = 'long'")) + f"] AS f_{n}" for n in BOUNDS) + " FROM good WHERE n % 24 = 0)" + "".join(
    f""", near_{n} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, row_id) AS rank FROM (
    SELECT query_id, up, down, row_id, plan_id, o, sqrt(list_sum(list_transform(list_zip({q}, {r}), lambda z: least(36, (z[1] - z[2]) ** 2))) / {size}) + CASE WHEN q.symbol = r.symbol THEN 0 ELSE 0.15::DOUBLE END AS dist
    FROM asked q JOIN rows_ r ON r.at_ms < q.at_ms)) WHERE rank <= 64), touch_{n} AS (
  SELECT query_id, rank, any_value(dist) AS dist, min(step) FILTER (CASE WHEN o = 0 THEN u ELSE d END >= up) AS tp_step, min(step) FILTER (CASE WHEN o = 0 THEN d ELSE u END >= down) AS sl_step
  FROM near_{n} LEFT JOIN fw USING (plan_id) GROUP BY query_id, rank), label_{n} AS (
  SELECT *, CASE WHEN least(tp_step, sl_step) <= {start} THEN NULL WHEN least(tp_step, sl_step) IS NULL OR least(tp_step, sl_step) > {end} THEN 'none' WHEN tp_step = sl_step THEN 'ambiguous'
    WHEN tp_step = least(tp_step, sl_step) THEN 'tp' ELSE 'sl' END AS label FROM touch_{n}), pick_{n} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM label_{n} WHERE label IN ('tp', 'sl', 'none')) WHERE k <= 16), post_{n} AS (
  SELECT query_id, count(*) AS cnt, [coalesce(sum(w) FILTER (label = 'tp'), 0) + 0.5, coalesce(sum(w) FILTER (label = 'sl'), 0) + 0.5, coalesce(sum(w) FILTER (label = 'none'), 0) + 0.5] AS alpha FROM (
    SELECT *, exp(-0.5 * (dist / greatest(0.25, max(dist) OVER (PARTITION BY query_id))) ** 2) AS w FROM pick_{n}) GROUP BY query_id)"""
    for n, (start, end), q, r, size in (
        ("4h", BOUNDS["4h"], "q.f_4h", "r.f_4h", 4),
        ("24h", BOUNDS["24h"], "list_concat(q.f_4h, q.f_24h)", "list_concat(r.f_4h, r.f_24h)", 8),
        ("7d", BOUNDS["7d"], "list_concat(q.f_4h, q.f_24h, q.f_7d)", "list_concat(r.f_4h, r.f_24h, r.f_7d)", 12),
    )
) + """, al AS (
  SELECT asked.query_id, coalesce(a.cnt, 0) AS n_4h, coalesce(b.cnt, 0) AS n_24h, coalesce(c.cnt, 0) AS n_7d, coalesce(a.alpha, [0.5, 0.5, 0.5]) AS a1, coalesce(b.alpha, [0.5, 0.5, 0.5]) AS a2, coalesce(c.alpha, [0.5, 0.5, 0.5]) AS a3
  FROM asked LEFT JOIN post_4h a USING (query_id) LEFT JOIN post_24h b USING (query_id) LEFT JOIN post_7d c USING (query_id)), e1 AS (
  SELECT *, a1[1] / list_sum(a1) AS tp_4h, a1[2] / list_sum(a1) AS sl_4h FROM al), e2 AS (
  SELECT *, tp_4h + (1 - tp_4h - sl_4h) * a2[1] / list_sum(a2) AS tp_24h, sl_4h + (1 - tp_4h - sl_4h) * a2[2] / list_sum(a2) AS sl_24h FROM e1), e3 AS (
  SELECT *, tp_24h + (1 - tp_24h - sl_24h) * a3[1] / list_sum(a3) AS tp_7d, sl_24h + (1 - tp_24h - sl_24h) * a3[2] / list_sum(a3) AS sl_7d FROM e2)"""


@query(f"WITH {_EMP} SELECT query_id, n_4h, n_24h, n_7d, " + ", ".join(f"round({p}_{n}, 6) AS {p}_{n}" for n in BOUNDS for p in ("tp", "sl")) + " FROM e3")
def empirical_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = empirical_stages(spark, sf_dir)
    return rounded(out.select("query_id", *[f"n_{n}" for n in BOUNDS], *[f"{p}_{n}" for n in BOUNDS for p in ("tp", "sl")]))


@query()
def empirical_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of the empirical engine's week by draws from its posteriors (a generator, so no SQL; tested by its moments)."""
    return rounded(engines.empirical_ranges(empirical_stages(spark, sf_dir), list(BOUNDS)))


# ---- an independent solver


@query()
def finite_difference_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-passage probabilities of every plan by finite differences, a check on the series (equal within 3e-4; tested against it)."""
    plans = with_first_passage(moved_plans(hourly(spark, sf_dir)))
    return rounded(engines.solved_by_differences(plans.repartition(spark.sparkContext.defaultParallelism, "plan_id"), "plan_id"))
