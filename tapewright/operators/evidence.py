"""Evidence on plans: touches resolved by trades, exits and entries on bars, gates on their data, and partitions by date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import bar_hits
from tapewright.operators.outcomes import touches


def next_bar_touches(plans: DataFrame, bars: DataFrame) -> DataFrame:
    """plans with the bar that opens at their at_ms + 1, and what it touches: stop_loss, take_profit, both or none.

    plans: plan_id, symbol, at_ms, side, stop, target; a join on symbol and open.
    """
    b = bars.select("symbol", (F.col("open_ms") - 1).alias("at_ms"), "open_ms", "close_ms", "low", "high")
    at_stop, at_target = bar_hits(F.col("side"), F.col("low"), F.col("high"), F.col("stop"), F.col("target"))
    touched = F.when(at_stop & at_target, "both").when(at_stop, "stop_loss").when(at_target, "take_profit").otherwise("none")
    return plans.join(b, ["symbol", "at_ms"]).withColumn("touched", touched)


def path_touches(plans: DataFrame, bars: DataFrame, horizon_ms: int) -> DataFrame:
    """plans with the first bar within the horizon that touches a level, however far on, and what it touches: stop_loss, take_profit or both.

    One aggregation over the interval join; plans whose levels are not touched have no row.
    """
    path = touches(plans.withColumn("entry", F.lit(None).cast("double")), bars, horizon_ms).where("at_stop or at_target")
    touched = F.when(F.col("at_stop") & F.col("at_target"), "both").when(F.col("at_stop"), "stop_loss").otherwise("take_profit")
    first = path.groupBy("plan_id").agg(F.min_by(F.struct("symbol", "at_ms", "side", "stop", "target", "open_ms", "close_ms", touched.alias("touched")), "close_ms").alias("f"))
    return first.select("plan_id", "f.*")


def resolved_by_trades(touched: DataFrame, trades: DataFrame, bucket_ms: int) -> DataFrame:
    """touched (as next_bar_touches and path_touches give it) with reason and touched_ms: of a bar that touches both levels, the first trade that touches either decides.

    Only such bars meet trades, on symbol and bucket; among trades of one time the smaller trade_id is first. A bar that no
    trade resolves stays ambiguous. All others have their own touch at the bar's open.
    """
    unclear = touched.where("touched = 'both'").select("plan_id", "symbol", "open_ms", "close_ms", "side", "stop", "target").withColumn("_b", F.floor(F.col("open_ms") / bucket_ms))
    ticks = trades.select("symbol", "ts_ms", "trade_id", "price").withColumn("_b", F.floor(F.col("ts_ms") / bucket_ms))
    at_stop, at_target = bar_hits(F.col("side"), F.col("price"), F.col("price"), F.col("stop"), F.col("target"))
    met = unclear.join(ticks, ["symbol", "_b"]).where(F.col("ts_ms").between(F.col("open_ms"), F.col("close_ms")) & (at_stop | at_target))
    first = met.groupBy("plan_id").agg(F.min_by(F.struct(F.when(at_stop, "stop_loss").otherwise("take_profit").alias("reason"), F.col("ts_ms").alias("touched_ms")), F.struct("ts_ms", "trade_id")).alias("first"))
    out = touched.join(first, "plan_id", "left")
    reason = F.when(F.col("touched") == "both", F.coalesce("first.reason", F.lit("ambiguous_same_candle"))).when(F.col("touched") != "none", F.col("touched"))
    at = F.when(F.col("first").isNotNull(), F.col("first.touched_ms")).when(reason.isNotNull(), F.col("open_ms"))
    return out.select("plan_id", "symbol", "touched", reason.alias("reason"), at.alias("touched_ms"))


def candle_gate(bars: DataFrame, keys: list[str], interval_ms: int, required: int) -> DataFrame:
    """keys, status and counts of what is wrong with the bars of each key: too few, values, ranges, durations, repeats, gaps."""
    w = Window.partitionBy(*keys).orderBy("open_ms")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    bad_value = ~F.coalesce((F.least(*prices) > 0) & (F.col("volume") >= 0) & (F.greatest(*prices, F.col("volume")) < float("inf")), F.lit(False))
    bad_range = (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))
    step = F.col("open_ms") - F.lag("open_ms").over(w)
    marked = bars.withColumn("_step", step)
    counts = marked.groupBy(*keys).agg(
        F.count("*").alias("bars"),
        F.count_if(bad_value).alias("bad_values"),
        F.count_if(bad_range).alias("bad_ranges"),
        F.count_if(F.col("close_ms") - F.col("open_ms") + 1 != interval_ms).alias("bad_durations"),
        F.count_if(F.col("_step") == 0).alias("repeats"),
        F.count_if(F.col("_step") > interval_ms).alias("gaps"),
    )
    fine = (F.col("bars") >= required) & (F.col("bad_values") + F.col("bad_ranges") + F.col("bad_durations") + F.col("repeats") + F.col("gaps") == 0)
    return counts.withColumn("status", F.when(fine, "approved").otherwise("rejected"))


def observation_problem(provider_ms: Column, asked_ms: Column, received_ms: Column, analysis_ms: Column, max_age_ms: Column) -> Column:
    """Why an observation must not be used at an analysis; null where it may."""
    return (
        F.when(asked_ms.isNull() | received_ms.isNull(), "missing_time")
        .when(received_ms < asked_ms, "received_before_request")
        .when(received_ms > analysis_ms, "received_after_analysis")
        .when(provider_ms > received_ms, "provider_time_after_receipt")
        .when(analysis_ms - F.coalesce(provider_ms, received_ms) > max_age_ms, "stale")
    )


def capture_spans(observations: DataFrame, key: str, limit_ms: int) -> DataFrame:
    """Of each analysis: observations, those without a provider's time, the span between receipts, and whether it is within the limit."""
    span = F.max("received_ms") - F.min("received_ms")
    return observations.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("provider_ms").isNull()).alias("untimed"), span.alias("span_ms"), (span <= limit_ms).alias("together"))


def date_cuts(rows: DataFrame, day: str) -> DataFrame:
    """development_end and calibration_end: the distinct dates at 60 and 80 per cent, each partition with a date at least; null below three dates."""
    days = rows.select(F.col(day).alias("d")).where("d is not null").distinct().agg(F.array_sort(F.collect_list("d")).alias("days"))
    n = F.size("days")
    first = F.greatest(F.lit(0), F.least(n - 3, F.floor(n * 0.6).cast("int") - 1))
    second = F.greatest(first + 1, F.least(n - 2, F.floor(n * 0.8).cast("int") - 1))
    enough = n >= 3
    return days.select(F.when(enough, F.try_element_at("days", first + 1)).alias("development_end"), F.when(enough, F.try_element_at("days", second + 1)).alias("calibration_end"))


def partition_of(day: Column, development_end: Column, calibration_end: Column) -> Column:
    return F.when(development_end.isNotNull(), F.when(day <= development_end, "development").when(day <= calibration_end, "calibration").otherwise("final_test"))


def problems(checks: dict[str, Column]) -> Column:
    """The names of all checks that a row fails; a null answer fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), n) for n, c in checks.items()]))


def dense_counts(rows: DataFrame, axes: dict[str, list[str]]) -> DataFrame:
    """Counts of rows for every combination of the axes' values, also of those without a row."""
    names = list(axes)
    own = rows.groupBy(*names).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(1).select(F.lit(0).alias("_"))
    for name, values in axes.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return grid.drop("_").join(own, names, "left").fillna({"n": 0})
