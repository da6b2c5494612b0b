"""Evaluation of probabilities and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.storage import stored

CLASSES = ("take_profit", "stop_loss", "expiry")


def losses(df: DataFrame, label: str = "label") -> DataFrame:
    """df with brier and log_loss of the columns p_tp, p_sl, p_expiry against a label."""
    p = dict(zip(CLASSES, ("p_tp", "p_sl", "p_expiry"), strict=True))
    brier = sum(((F.col(c) - (F.col(label) == n).cast("double")) ** 2 for n, c in p.items()), F.lit(0.0))
    own = F.coalesce(*[F.when(F.col(label) == n, F.col(c)) for n, c in p.items()])
    return df.withColumn("brier", brier).withColumn("log_loss", -F.ln(F.greatest(own, F.lit(1e-15))))


def rank_auc(df: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve with tied scores counted half.

    Scores are grouped first; the running count of negatives runs over distinct scores by key.
    """
    tied = df.groupBy(*keys, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    below = Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = tied.withColumn("w", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + 0.5 * F.col("n")))
    out = wins.groupBy(*keys).agg(F.sum("w").alias("w"), F.sum("p").alias("n_positive"), F.sum("n").alias("n_negative"))
    return out.select(*keys, "n_positive", "n_negative", F.when((F.col("n_positive") > 0) & (F.col("n_negative") > 0), F.col("w") / (F.col("n_positive") * F.col("n_negative"))).alias("auc"))


def calibration(df: DataFrame, probability: str, hit: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins: count, mean probability, rate, and each bin's part of the expected calibration error."""
    place = F.least(F.floor(F.col(probability) * bins), F.lit(bins - 1)).cast("int")
    out = df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(probability).alias("mean_p"), F.avg(hit.cast("double")).alias("rate"))
    everything = Window.partitionBy(F.lit(1))  # a row for each bin
    return out.withColumn("ece_part", F.col("n") / F.sum("n").over(everything) * F.abs(F.col("mean_p") - F.col("rate")))


#: Ranges of p values that are ranked by themselves.
RANGES = 4096


def benjamini_hochberg(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Step-up adjusted p values of a table of tests (one row for each).

    Ranks and running minima go in two levels, within RANGES equal ranges of p and over the ranges, so no task sees all tests
    (unless most have one p).
    """
    place = F.least(F.floor(F.col(p) * RANGES), F.lit(RANGES - 1)).cast("int")
    placed = stored(tests.select(name, p, place.alias("_b")), "tests")  # read by ranks and minima, and tests may be costly
    everything = Window.partitionBy(F.lit(1)).orderBy("_b")  # a row for each range
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_b", (F.sum("_n").over(everything) - F.col("_n")).alias("_ahead"), F.sum("_n").over(Window.partitionBy(F.lit(1))).alias("_m"))
    within = Window.partitionBy("_b").orderBy(p, name)
    ranked = placed.join(F.broadcast(sizes), "_b").withColumn("_r", F.row_number().over(within) + F.col("_ahead"))
    ranked = ranked.withColumn("_raw", F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_r")))
    behind = ranked.groupBy("_b").agg(F.min("_raw").alias("_low"))
    behind = behind.select("_b", F.min("_low").over(everything.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    onward = F.min("_raw").over(within.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("_own", onward).join(F.broadcast(behind), "_b").select(name, p, F.least("_own", "_later").alias("q"))


def block_bootstrap(blocks: DataFrame, block: str, value: str, draws: int, seed: int) -> DataFrame:
    """Resampled means of block means: draw, mean; a draw picks as many blocks as there are, by digests, with replacement.

    blocks has a row for each block (a day or week), so it is small; the work is draws times blocks rows, spread by draw.
    """
    numbered = blocks.withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(block)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    picks = numbered.select("_i", "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("draw").cast("string"), F.col("_i").cast("string")).cast("binary"))
    chosen = picks.select("draw", (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n")).alias("_i"))
    return chosen.join(numbered.select("_i", value), "_i").groupBy("draw").agg(F.avg(value).alias("mean"))


def plain_quantile(values: Column, q: float) -> Column:
    """The element of a sorted array at floor(q * (n - 1)), without interpolation."""
    return F.element_at(F.array_sort(values), (F.floor(q * (F.size(values) - 1)) + 1).cast("int"))
