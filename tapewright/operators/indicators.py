"""Technical indicators on bars (symbol, open_ms, ...): bounded row frames, and folds over bounded arrays.

Recursive averages depend on where they start, so each bar's value starts at the first bar of its own lookback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def by_time() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("open_ms")



def back(n: int) -> WindowSpec:
    """The last n rows, the own one included."""
    return by_time().rowsBetween(-(n - 1), 0)


def changes(bars: DataFrame) -> DataFrame:
    """bars with the bar number, the last close, change, true range and log return."""
    prior = F.lag("close").over(by_time())
    return (
        bars.withColumn("n", F.row_number().over(by_time()))
        .withColumn("prior", prior)
        .withColumn("change", F.col("close") - F.col("prior"))
        .withColumn("true_range", F.when(F.col("prior").isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prior")), F.abs(F.col("low") - F.col("prior")))))
        .withColumn("ret", F.ln(F.col("close") / F.col("prior")))
    )


def simple_indicators(bars: DataFrame, period: int = 14, span: int = 24) -> DataFrame:
    """Simple-mean RSI and ATR, high and low of the span, place in it, volume ratio, Bollinger width; one sort for all frames."""
    gain = F.avg(F.greatest("change", F.lit(0.0))).over(back(period))
    loss = F.avg(F.greatest(-F.col("change"), F.lit(0.0))).over(back(period))
    high, low = F.max("high").over(back(span)), F.min("low").over(back(span))
    mean20 = F.avg("close").over(back(20))
    out = changes(bars).select(
        "symbol",
        "open_ms",
        "close",
        F.when(F.col("n") <= period, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / loss)).alias("rsi"),
        F.when(F.col("n") > period, F.avg("true_range").over(back(period))).alias("atr"),
        high.alias("span_high"),
        low.alias("span_low"),
        F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5).alias("span_place"),
        (F.col("volume") / F.avg("volume").over(back(20))).alias("volume_ratio"),
        F.when(F.col("n") >= 20, 4 * F.stddev_pop("close").over(back(20)) / mean20).alias("bollinger_width"),
    )
    return out


def ema_of(values: Column, period: int) -> Column:
    """Exponential average of an array, seeded with its first value."""
    alpha = 2.0 / (period + 1)
    return F.aggregate(F.slice(values, 2, 100_000), F.element_at(values, 1), lambda acc, x: acc + alpha * (x - acc))


def seeded_ema_of(values: Column, period: int) -> Column:
    """Exponential average of an array, seeded with the mean of its first values; null for shorter arrays."""
    alpha = 2.0 / (period + 1)
    seed = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda acc, x: acc + x) / period
    return F.when(F.size(values) >= period, F.aggregate(F.slice(values, period + 1, 100_000), seed, lambda acc, x: acc + alpha * (x - acc)))


def wilder_of(values: Column, period: int) -> Column:
    """Wilder's smoothing of an array: the mean of the first values, then a share of 1 / period for each further one."""
    seed = F.aggregate(F.slice(values, 1, period), F.lit(0.0), lambda acc, x: acc + x) / period
    return F.when(F.size(values) >= period, F.aggregate(F.slice(values, period + 1, 100_000), seed, lambda acc, x: (acc * (period - 1) + x) / period))


def recursive_indicators(bars: DataFrame, lookback: int = 60, period: int = 14) -> DataFrame:
    """EMAs of either seeding, Wilder's RSI and ATR at each bar that has a full lookback."""
    arrays = changes(bars).select("symbol", "open_ms", "n", *[F.collect_list(c).over(back(lookback)).alias(f"a_{c}") for c in ("close", "change", "true_range")])
    arrays = arrays.where(F.col("n") > lookback)
    up = wilder_of(F.transform("a_change", lambda x: F.greatest(x, F.lit(0.0))), period)
    down = wilder_of(F.transform("a_change", lambda x: F.greatest(-x, F.lit(0.0))), period)
    return arrays.select(
        "symbol",
        "open_ms",
        ema_of(F.col("a_close"), 9).alias("ema_9"),
        ema_of(F.col("a_close"), 21).alias("ema_21"),
        seeded_ema_of(F.col("a_close"), 50).alias("seeded_ema_50"),
        F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)).alias("wilder_rsi"),
        wilder_of(F.col("a_true_range"), period).alias("wilder_atr"),
    )


def path_features(bars: DataFrame, horizon: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """Realised variance, displacement, variation and signed efficiency of the last horizon returns, and the horizon's volume; keep names columns of bars to carry on."""
    frame = back(horizon)
    moved, path = F.sum("ret").over(frame), F.sum(F.abs("ret")).over(frame)
    return changes(bars).select(
        "symbol",
        "open_ms",
        "n",
        F.sum(F.col("ret") * F.col("ret")).over(frame).alias("realised_variance"),
        moved.alias("displacement"),
        path.alias("variation"),
        F.when(path > 0, moved / path).alias("efficiency"),
        F.sum("volume").over(frame).alias("horizon_volume"),
        *keep,
    ).where(F.col("n") > horizon)


def midrank(value: Column, reference: Column) -> Column:
    """Share of an array below a value, equal ones counted half."""
    below = F.size(F.filter(reference, lambda x: x < value))
    equal = F.size(F.filter(reference, lambda x: x == value))
    return F.when(F.size(reference) > 0, (below + 0.5 * equal) / F.size(reference))


def median_of(values: Column) -> Column:
    """Median of an array, null for an empty one."""
    s, n = F.array_sort(values), F.size(values)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2
    return F.when(n > 0, middle)


def prior_rank(features: DataFrame, column: str, step: int, count: int = 60) -> DataFrame:
    """Midrank, median and robust z of a column against count strictly prior values, step bars apart."""
    prior = Window.partitionBy("symbol", "_phase").orderBy("open_ms").rowsBetween(-count, -1)
    ranked = features.withColumn("_phase", F.col("n") % step).withColumn("reference", F.collect_list(column).over(prior)).where(F.size("reference") == count)
    middle = median_of(F.col("reference"))
    ranked = ranked.withColumn("median", middle)
    spread = median_of(F.transform("reference", lambda x: F.abs(x - F.col("median"))))
    ranked = ranked.withColumn("mad", spread)
    z = F.when(F.col("mad") > 0, (F.col(column) - F.col("median")) / (1.4826 * F.col("mad")))
    return ranked.select("symbol", "open_ms", F.col(column).alias("value"), midrank(F.col(column), F.col("reference")).alias("midrank"), "median", "mad", z.alias("robust_z"))


def theil_sen(df: DataFrame, keys: list[str], order: str, value: str, most: int) -> DataFrame:
    """Median slope of all pairs of the last rows of each key (at most `most` rows, so the pairs are bounded)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    arrays = last.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("v"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.transform(F.sequence(i + 1, F.size("v")), lambda j: (F.element_at("v", j) - F.element_at("v", i)) / (j - i))))
    return arrays.where(F.size("v") > 1).select(*keys, F.size("v").alias("n"), median_of(pairs).alias("slope"))
