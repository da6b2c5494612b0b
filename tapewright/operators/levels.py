"""Price levels: pivots, alternating legs, Fibonacci levels, order-book walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Retracements and extensions of a leg.
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618, 2.0)


def pivots(bars: DataFrame, half: int = 3) -> DataFrame:
    """Bars whose high (low) is the only largest (smallest) of the half bars on either side: symbol, open_ms, n, kind, price."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    near = w.rowsBetween(-half, half)
    around = bars.withColumn("n", F.row_number().over(w)).withColumn("_c", F.count("*").over(near)).withColumn("_h", F.collect_list("high").over(near)).withColumn("_l", F.collect_list("low").over(near))
    full = around.where(F.col("_c") == 2 * half + 1)
    top = (F.array_max("_h") == F.col("high")) & (F.size(F.filter("_h", lambda x: x == F.col("high"))) == 1)
    bottom = (F.array_min("_l") == F.col("low")) & (F.size(F.filter("_l", lambda x: x == F.col("low"))) == 1)
    found = full.select("symbol", "open_ms", "n", F.explode(F.array_compact(F.array(F.when(top, F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(bottom, F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))).alias("p"))
    return found.select("symbol", "open_ms", "n", "p.kind", "p.price")


def alternating(found: DataFrame) -> DataFrame:
    """Runs of pivots of one kind become their most extreme one."""
    w = Window.partitionBy("symbol").orderBy("open_ms", "kind")
    runs = found.withColumn("_new", (F.lag("kind").over(w).isNull() | (F.lag("kind").over(w) != F.col("kind"))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    signed = F.when(F.col("kind") == "high", F.col("price")).otherwise(-F.col("price"))
    best = runs.groupBy("symbol", "run", "kind").agg(F.max_by(F.struct("open_ms", "price"), F.struct(signed, -F.col("open_ms"))).alias("p"))
    return best.select("symbol", "run", "kind", "p.open_ms", "p.price")


def fibonacci(legs: DataFrame) -> DataFrame:
    """Levels of each symbol's last leg (two alternating pivots): symbol, kind, ratio, level."""
    w = Window.partitionBy("symbol").orderBy("run")
    pairs = legs.withColumn("start", F.lag("price").over(w)).where("start is not null")
    last = pairs.groupBy("symbol").agg(F.max_by(F.struct("start", F.col("price").alias("end")), "run").alias("leg")).select("symbol", "leg.*")
    levels = [F.struct(F.lit("retracement").alias("kind"), F.lit(r).alias("ratio"), (F.col("end") - r * (F.col("end") - F.col("start"))).alias("level")) for r in RETRACEMENTS]
    levels += [F.struct(F.lit("extension").alias("kind"), F.lit(r).alias("ratio"), (F.col("start") + r * (F.col("end") - F.col("start"))).alias("level")) for r in EXTENSIONS]
    return last.select("symbol", F.explode(F.array(*levels)).alias("l")).select("symbol", "l.kind", "l.ratio", "l.level")


def nearest_level(levels: DataFrame, prices: DataFrame) -> DataFrame:
    """The level of each symbol that lies nearest to its price, by logarithmic distance."""
    joined = levels.where("level > 0").join(prices, "symbol")
    return joined.groupBy("symbol", "price").agg(F.min_by(F.struct("kind", "ratio", "level"), F.struct(F.abs(F.ln(F.col("level") / F.col("price"))), "kind", "ratio")).alias("l")).select("symbol", "price", "l.*")


def book_walk(side: Column, wanted: Column) -> Column:
    """struct(filled, vwap, fill_ratio) of a market order through one side of a book, an array of (price, qty) best first."""
    start = F.struct(F.lit(0.0).alias("got"), F.lit(0.0).alias("paid"))
    walked = F.aggregate(
        side,
        start,
        lambda acc, level: F.struct(
            (acc["got"] + F.greatest(F.lit(0.0), F.least(level["qty"], wanted - acc["got"]))).alias("got"),
            (acc["paid"] + level["price"] * F.greatest(F.lit(0.0), F.least(level["qty"], wanted - acc["got"]))).alias("paid"),
        ),
    )
    return F.struct(walked["got"].alias("filled"), F.when(walked["got"] > 0, walked["paid"] / walked["got"]).alias("vwap"), (walked["got"] / wanted).alias("fill_ratio"))
