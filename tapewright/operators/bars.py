"""Bars: rollups of trades and bars, gaps, and quality gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import bucket_start


def rollup_trades(trades: DataFrame, size_ms: int) -> DataFrame:
    """OHLCV bars of trades (symbol, ts_ms, trade_id, price, qty, maker): one hash aggregation with map-side combine."""
    order = F.struct("ts_ms", "trade_id")
    return (
        trades.groupBy("symbol", bucket_start(F.col("ts_ms"), size_ms).alias("open_ms"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("qty").alias("volume"),
            F.sum(F.col("price") * F.col("qty")).alias("quote_volume"),
            F.sum(F.when(~F.col("maker"), F.col("price") * F.col("qty")).otherwise(0.0)).alias("taker_buy_quote"),
            F.count("*").alias("n_trades"),
        )
        .withColumn("close_ms", F.col("open_ms") + size_ms - 1)
    )


def rollup_bars(bars: DataFrame, base_ms: int, size_ms: int) -> DataFrame:
    """Coarser bars; only buckets that hold every base bar once and without a gap."""
    wanted = size_ms // base_ms
    return (
        bars.groupBy("symbol", bucket_start(F.col("open_ms"), size_ms).alias("bucket"))
        .agg(
            F.min_by("open", "open_ms").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_ms").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("quote_volume").alias("quote_volume"),
            F.count("*").alias("n"),
            F.count_distinct("open_ms").alias("d"),
        )
        .where((F.col("n") == wanted) & (F.col("d") == wanted))
        .select("symbol", F.col("bucket").alias("open_ms"), "open", "high", "low", "close", "volume", "quote_volume", (F.col("bucket") + size_ms - 1).alias("close_ms"))
    )


def merge_ranges(ranges: DataFrame, keys: list[str], start: str, end: str, slack: int = 0) -> DataFrame:
    """Union of intervals by key: those that overlap or lie within slack become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(before.isNull() | (F.col(start) > before + slack), 1).otherwise(0)
    numbered = ranges.withColumn("_new", fresh).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def latest_by(df: DataFrame, keys: list[str], order: Column, *values: str) -> DataFrame:
    """The latest row of each key, by an aggregation and not a sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")


def quality_report(bars: DataFrame, step_ms: int) -> DataFrame:
    """Per symbol: bars, repeated opens, gaps, incoherent prices, and whether a window of them may be used."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    gap = F.col("open_ms") - F.lag("open_ms").over(w)
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")) | (F.col("low") <= 0)
    out = bars.withColumn("_gap", gap).groupBy("symbol").agg(
        F.count("*").alias("n_bars"),
        F.count_if(F.col("_gap") == 0).alias("n_repeated"),
        F.count_if(F.col("_gap") > step_ms).alias("n_gaps"),
        F.count_if(bad).alias("n_incoherent"),
        F.max("close_ms").alias("last_close_ms"),
    )
    return out.withColumn("usable", (F.col("n_repeated") == 0) & (F.col("n_gaps") == 0) & (F.col("n_incoherent") == 0))


def trade_flow(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Taker buys and sells, their difference and ratio."""
    worth = F.col("price") * F.col("qty")
    out = trades.groupBy(*keys).agg(F.sum(F.when(~F.col("maker"), worth).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("maker"), worth).otherwise(0.0)).alias("sell"), F.count("*").alias("n_trades"))
    return out.select(*keys, "n_trades", "buy", "sell", (F.col("buy") - F.col("sell")).alias("delta"), F.when(F.col("buy") + F.col("sell") > 0, F.col("buy") / (F.col("buy") + F.col("sell"))).otherwise(0.0).alias("buy_ratio"))


def market_breadth(bars: DataFrame, windows: dict[str, int], strong: float = 5.0) -> DataFrame:
    """Per bar time and window: symbols with a bar a window earlier, the percentage that rose, the median change, the percentage of strong moves.

    Changes are percentages of the earlier close; the earlier bar is met by an equi-join on symbol and time, so gaps give no change.
    """
    asked = bars.select("symbol", "open_ms", "close", F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.lit(ms).cast("long").alias("ms")) for n, ms in windows.items()])).alias("w"))
    asked = asked.select("symbol", "open_ms", "close", "w.window", (F.col("open_ms") - F.col("w.ms")).alias("_then"))
    earlier = bars.select(F.col("symbol").alias("_s"), F.col("open_ms").alias("_o"), F.col("close").alias("_c"))
    moved = asked.join(earlier, (F.col("symbol") == F.col("_s")) & (F.col("_then") == F.col("_o"))).withColumn("_x", F.when(F.col("_c") == 0, 0.0).otherwise((F.col("close") - F.col("_c")) / F.col("_c") * 100))
    return moved.groupBy("open_ms", "window").agg(
        F.count("*").alias("n"),
        (F.count_if(F.col("_x") > 0) / F.count("*") * 100).alias("advancers_pct"),
        F.median("_x").alias("median_change_pct"),
        (F.count_if(F.abs("_x") >= strong) / F.count("*") * 100).alias("strong_pct"),
    )


def book_summary(levels: DataFrame, key: str) -> DataFrame:
    """Per book (levels: key, bid, price, qty): notional of either side, their imbalance, best prices (0: none) and spread in percent of the middle."""
    bid, worth = F.col("bid"), F.col("price") * F.col("qty")
    out = levels.groupBy(key).agg(
        F.sum(F.when(bid, worth).otherwise(0.0)).alias("bid_notional"),
        F.sum(F.when(bid, 0.0).otherwise(worth)).alias("ask_notional"),
        F.coalesce(F.max(F.when(bid, F.col("price"))), F.lit(0.0)).alias("best_bid"),
        F.coalesce(F.min(F.when(~bid, F.col("price"))), F.lit(0.0)).alias("best_ask"),
    )
    total, middle = F.col("bid_notional") + F.col("ask_notional"), (F.col("best_bid") + F.col("best_ask")) / 2
    both = (F.col("best_bid") != 0) & (F.col("best_ask") != 0)
    return out.withColumn("imbalance", F.when(total != 0, (F.col("bid_notional") - F.col("ask_notional")) / total).otherwise(0.0)).withColumn("spread_pct", F.when(both, (F.col("best_ask") - F.col("best_bid")) / middle * 100).otherwise(0.0))
