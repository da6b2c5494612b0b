"""Audits of closed cases and of models' predictions, scalings of features, and reads of price clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The classes of an outcome, in the order that settles ties.
CLASSES = ("take_profit", "stop_loss", "expiry")


def case_groups(cases: DataFrame, keys: list[str], flags: dict[str, Column], means: dict[str, Column]) -> DataFrame:
    """key, name, cases, and of each flag how many and which share of the cases that have it; of each number the mean.

    One row for all cases (key all) and one for each value of each key, all from one pass; a missing or empty value is sin_dato.
    """
    names = F.array(F.struct(F.lit("all").alias("key"), F.lit("all").alias("name")), *[F.struct(F.lit(k).alias("key"), F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit("sin_dato")).alias("name")) for k in keys])
    rows = cases.select(F.explode(names).alias("g"), *[c.alias(f"_f{i}") for i, c in enumerate(flags.values())], *[c.alias(f"_m{i}") for i, c in enumerate(means.values())])
    counts = [x for i, n in enumerate(flags) for x in (F.count_if(f"_f{i}").alias(n), F.avg(F.col(f"_f{i}").cast("double")).alias(f"{n}_rate"))]
    return rows.groupBy("g.key", "g.name").agg(F.count("*").alias("cases"), *counts, *[F.avg(f"_m{i}").alias(f"avg_{n}") for i, n in enumerate(means)])


def path_touch(path: Column, side: Column, level: Column, adverse: bool) -> Column:
    """The index of the first price of an array that reaches a level, on the target's side or the other; null without one."""
    up = (side == "long") != F.lit(adverse)
    reached = F.transform(path, lambda p: F.when(up, p >= level).otherwise(p <= level))
    at = F.array_position(reached, F.lit(True))
    return F.when(at > 0, (at - 1).cast("int"))


def first_touch_of(target: Column, adverse: Column) -> Column:
    """Which of two touches came first."""
    return (
        F.when(target.isNull() & adverse.isNull(), "ninguno")
        .when(adverse.isNull(), "solo_objetivo")
        .when(target.isNull(), "solo_adverso")
        .when(target < adverse, "objetivo_primero")
        .when(adverse < target, "adverso_primero")
        .otherwise("mismo_punto")
    )


# ---- predictions


def prediction_metrics(rows: DataFrame, keys: list[str], label: Column, probabilities: Column) -> DataFrame:
    """Of each key: records, Brier score, log loss, accuracy of the likeliest class, mean probability of the outcome, and accuracy between target and stop.

    probabilities is a map by class; of equal ones the first class counts.
    """
    p = rows.select(*keys, label.alias("_l"), *[probabilities[c].alias(f"_p{i}") for i, c in enumerate(CLASSES)])
    ps = [F.col(f"_p{i}") for i in range(3)]
    own = F.element_at(F.array(*ps), F.array_position(F.array(*map(F.lit, CLASSES)), F.col("_l")).cast("int"))
    top = F.when((ps[0] >= ps[1]) & (ps[0] >= ps[2]), CLASSES[0]).when(ps[1] >= ps[2], CLASSES[1]).otherwise(CLASSES[2])
    brier = sum((x - (F.col("_l") == c).cast("int")) ** 2 for x, c in zip(ps, CLASSES, strict=True))
    binary = F.col("_l").isin(*CLASSES[:2])
    either = F.when(ps[0] >= ps[1], CLASSES[0]).otherwise(CLASSES[1])
    return p.groupBy(*keys).agg(
        F.count("*").alias("records"),
        F.avg(brier).alias("brier"),
        F.avg(-F.ln(F.greatest(own, F.lit(1e-15)))).alias("log_loss"),
        F.avg((top == F.col("_l")).cast("int")).alias("accuracy"),
        F.avg(own).alias("mean_probability"),
        F.count_if(binary).alias("binary_records"),
        F.avg(F.when(binary, (either == F.col("_l")).cast("int"))).alias("binary_accuracy"),
        *[F.count_if((F.col("_l") == a) & (top == b)).alias(f"{a}_as_{b}") for a in CLASSES for b in CLASSES],
    )


def metric_deltas(metrics: DataFrame, keys: list[str], model: str, reference: str, candidate: str) -> DataFrame:
    """What a candidate gains over a reference, of the rows of prediction_metrics that name a model."""
    ref = metrics.where(F.col(model) == reference).select(*keys, *[F.col(c).alias(f"_{c}") for c in ("brier", "log_loss", "accuracy", "mean_probability")])
    own = metrics.where(F.col(model) == candidate)
    out = own.join(ref, keys)
    gain = lambda c: F.col(f"_{c}") - F.col(c)
    return out.select(
        *keys,
        gain("brier").alias("brier_gain"),
        (gain("brier") / F.col("_brier") * 100).alias("brier_gain_pct"),
        gain("log_loss").alias("log_loss_gain"),
        (gain("log_loss") / F.col("_log_loss") * 100).alias("log_loss_gain_pct"),
        (-gain("accuracy")).alias("accuracy_gain"),
        (-gain("mean_probability")).alias("probability_gain"),
    )


# ---- scalings and analogs


def standard_scaling(rows: DataFrame, keys: list[str], value: str, least: float = 1e-12) -> DataFrame:
    """Mean and population deviation of each key; a deviation of next to nothing counts as 1."""
    out = rows.groupBy(*keys).agg(F.avg(value).alias("center"), F.stddev_pop(value).alias("scale"))
    return out.withColumn("scale", F.when(F.col("scale") > least, F.col("scale")).otherwise(1.0))


def robust_scaling(rows: DataFrame, keys: list[str], value: str, least: float = 1e-9) -> DataFrame:
    """Median and scaled median of absolute deviations of each key; the deviation stands in where that is next to nothing.

    The medians are exact and hold a key's distinct values; keys are features of a fitting sample.
    """
    centers = rows.groupBy(*keys).agg(F.median(value).alias("center"), F.stddev_pop(value).alias("_dev"))
    spread = rows.join(F.broadcast(centers), keys).groupBy(*keys).agg(F.first("center").alias("center"), F.first("_dev").alias("_dev"), (F.median(F.abs(F.col(value) - F.col("center"))) * 1.4826).alias("_mad"))
    return spread.select(*keys, "center", F.greatest(F.when(F.col("_mad") > least, F.col("_mad")).otherwise(F.col("_dev")), F.lit(least)).alias("scale"))


def capped_distance(left: Column, right: Column, cap: float = 36.0) -> Column:
    """Root of the mean squared difference of two arrays, each square at most cap."""
    squares = F.zip_with(left, right, lambda a, b: F.least(F.lit(cap), (a - b) * (a - b)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(left))


def analog_probabilities(analogs: DataFrame, key: str, label: str, distance: str, prior: float = 0.5) -> DataFrame:
    """key and a probability of each class: analogs weigh by a normal kernel as wide as the furthest of them (0.25 at least), and each class has a prior."""
    width = analogs.groupBy(key).agg(F.greatest(F.max(distance), F.lit(0.25)).alias("_w"))
    weight = F.exp(-0.5 * (F.col(distance) / F.col("_w")) ** 2)
    sums = analogs.join(width, key).groupBy(key).agg(*[F.sum(F.when(F.col(label) == c, weight).otherwise(0.0)).alias(c) for c in CLASSES])
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0])) + prior * len(CLASSES)
    return sums.select(key, *[((F.col(c) + prior) / total).alias(c) for c in CLASSES])


def frontier_step(frontier: Column, threshold: Column) -> Column:
    """The step of the first (level, step) of a rising frontier that reaches a threshold; null without one."""
    return F.try_element_at(F.filter(frontier, lambda f: f["level"] >= threshold), F.lit(1))["step"]


# ---- clusters


def nearest_cluster(clusters: Column, price: Column) -> Column:
    """The cluster (price, notional) nearest to a price; of two as near the first."""
    known = F.filter(clusters, lambda c: c["price"].isNotNull())
    far = F.transform(known, lambda c, i: F.struct(F.abs(c["price"] - price).alias("d"), i.alias("i"), c.alias("c")))
    return F.array_min(far)["c"]


def cluster_before_stop(clusters: Column, price: Column, stop: Column, side: Column) -> Column:
    """The largest cluster between a price and a stop, the stop's own level included; of two as large the first."""
    way = F.filter(clusters, lambda c: F.when(side == "short", (c["price"] > price) & (c["price"] <= stop)).otherwise((c["price"] < price) & (c["price"] >= stop)))
    large = F.transform(way, lambda c, i: F.struct(F.coalesce(c["notional"], F.lit(0.0)).alias("n"), (-i).alias("i"), c.alias("c")))
    return F.array_max(large)["c"]


def proximity(distance_pct: Column, tolerance_pct: Column) -> Column:
    return F.when(distance_pct.isNull(), "sin_datos").when(distance_pct <= tolerance_pct, "coincide").when(distance_pct <= tolerance_pct * 2, "cercana").otherwise("lejana")


def trade_state(side: Column, entry: Column, stop: Column, target: Column, margin: Column, leverage: Column, price: Column) -> Column:
    """variation in percent, profit, and the state of a trade at a price; the stop comes first."""
    sign = F.when(side == "long", 1).otherwise(-1)
    moved = (price - entry) / entry
    state = F.when(sign * (price - stop) <= 0, "STOP LOSS").when(sign * (price - target) >= 0, "TAKE PROFIT").otherwise("ABIERTA")
    return F.struct((moved * 100).alias("variation_pct"), (margin * leverage * sign * moved).alias("profit"), state.alias("state"))
