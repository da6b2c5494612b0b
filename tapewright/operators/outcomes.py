"""Outcomes of trade plans on later bars: first touch, excursions, frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import bar_hits
from tapewright.operators.joins import interval_join


def touches(plans: DataFrame, bars: DataFrame, horizon_ms: int) -> DataFrame:
    """Every later bar of each plan within its horizon, with whether it touches stop or target.

    plans: plan_id, symbol, at_ms, side, entry, stop, target. A bar belongs to a plan if it closes in (at_ms, at_ms + horizon].
    """
    ends = plans.select("plan_id", "symbol", "at_ms", "side", "entry", "stop", "target").withColumn("until_ms", F.col("at_ms") + horizon_ms)
    path = interval_join(ends, bars.select("symbol", "open_ms", "close_ms", "high", "low", F.col("close").alias("bar_close")), ["symbol"], "at_ms", "until_ms", "close_ms", horizon_ms)
    at_stop, at_target = bar_hits(F.col("side"), F.col("low"), F.col("high"), F.col("stop"), F.col("target"))
    return path.withColumn("at_stop", at_stop).withColumn("at_target", at_target)


def excursions(side: Column, entry: Column, high: Column, low: Column) -> tuple[Column, Column]:
    """Best and worst move in percent of the entry, from the extremes of a path; the best is not below 0, the worst not above."""
    long = side == "long"
    best = F.when(long, high / entry - 1).otherwise(1 - low / entry) * 100
    worst = F.when(long, low / entry - 1).otherwise(1 - high / entry) * 100
    return F.greatest(best, F.lit(0.0)), F.least(worst, F.lit(0.0))


def first_touch(plans: DataFrame, bars: DataFrame, horizon_ms: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """plan_id, label, touch_ms, n_bars, mfe, mae, last_close of every plan; a bar that touches both levels is ambiguous.

    One aggregation over the interval join and the plans themselves, so that plans without a later bar (unresolved) need no join. keep names columns
    of plans to carry on.
    """
    path = touches(plans, bars, horizon_ms)
    hit = F.col("at_stop") | F.col("at_target")
    label = F.when(F.col("at_stop") & F.col("at_target"), "ambiguous").when(F.col("at_stop"), "stop_loss").otherwise("take_profit")
    met = path.select("plan_id", F.when(hit, label).alias("hit"), F.when(hit, F.col("close_ms")).alias("hit_ms"), "close_ms", "high", "low", "bar_close")
    own = plans.select("plan_id", F.struct("side", "entry", *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("plan"))
    seen = met.unionByName(own, allowMissingColumns=True).groupBy("plan_id").agg(
        F.first("plan", ignorenulls=True).alias("plan"),
        F.min_by("hit", "hit_ms").alias("hit"),
        F.min("hit_ms").alias("touch_ms"),
        F.count("close_ms").alias("n_bars"),
        F.max("high").alias("top"),
        F.min("low").alias("bottom"),
        F.max_by("bar_close", "close_ms").alias("last_close"),
    )
    best, worst = excursions(F.col("plan.side"), F.col("plan.entry"), F.col("top"), F.col("bottom"))
    name = F.when(F.col("n_bars") == 0, "unresolved").otherwise(F.coalesce("hit", F.lit("expiry")))
    return seen.select("plan_id", name.alias("label"), "touch_ms", "n_bars", best.alias("mfe"), worst.alias("mae"), "last_close", *[F.col(f"plan.k{i}").alias(c) for i, c in enumerate(keep)])


def nested_labels(plans: DataFrame, bars: DataFrame, horizons_ms: list[int]) -> DataFrame:
    """plan_id and a label for each horizon from one path: the first touch decides for every horizon that holds it."""
    whole = first_touch(plans, bars, max(horizons_ms), ("at_ms",))
    labels = [F.when(F.col("touch_ms") <= F.col("at_ms") + h, F.col("label")).otherwise(F.when(F.col("label") == "unresolved", "unresolved").otherwise("expiry")).alias(f"label_{h // 3_600_000}h") for h in horizons_ms]
    return whole.select("plan_id", *labels)


def frontiers(plans: DataFrame, bars: DataFrame, horizon_ms: int, step_ms: int | None = None) -> DataFrame:
    """plan_id, direction, step, level: the bars at which a path's largest log move up or down grows.

    Steps count a path's bars, or units of step_ms since the plan, which do not depend on missing bars.
    """
    count = F.row_number().over(Window.partitionBy("plan_id").orderBy("close_ms")) if step_ms is None else F.ceil((F.col("close_ms") - F.col("at_ms")) / step_ms).cast("int")
    path = touches(plans, bars, horizon_ms).withColumn("step", count)
    moves = path.select("plan_id", "step", F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.ln(F.col("high") / F.col("entry")).alias("move")), F.struct(F.lit("down").alias("direction"), F.ln(F.col("entry") / F.col("low")).alias("move")))).alias("m")).select("plan_id", "step", "m.*")
    before = Window.partitionBy("plan_id", "direction").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("move").over(before), F.lit(0.0))
    return moves.withColumn("_top", top).where(F.col("move") > F.col("_top")).select("plan_id", "direction", "step", F.col("move").alias("level"))
