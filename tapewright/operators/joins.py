"""Joins on time: as-of, intervals, and nearest neighbours in blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with value: the struct of right's latest row of the key at or before left's time; of rows at one time the largest value.

    Both sides are put in one stream ordered by time, right before left at equal times; the last right row is carried on. One
    shuffle, no pair is made. right has the columns keys, at and value.
    """
    columns = left.columns
    both = left.select(*columns, F.lit(1).alias("_kind"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(right.select(*keys, at, F.lit(0).alias("_kind"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_kind = 1").select(*columns, value)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, bucket: int) -> DataFrame:
    """Pairs of left's intervals (start, end] and right's points in them: an equi-join on key and time bucket, then the exact test.

    A left row is copied once for each bucket that its interval meets, so buckets should be about as long as intervals.
    """
    dealt = left.withColumn("_b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    points = right.withColumn("_b", F.floor(F.col(at) / bucket))
    return dealt.join(points, [*keys, "_b"]).where((F.col(at) > F.col(start)) & (F.col(at) <= F.col(end))).drop("_b")


def nearest_in_blocks(queries: DataFrame, rows: DataFrame, distance: Column, allowed: Column, k: int, n_rows: int, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, row_id, dist: the k nearest rows of each query; rows lie in blocks, each block's best are merged.

    queries is a stated set; it meets each block once.
    """
    n = max(1, math.ceil(n_rows / block_rows))
    blocks = rows.withColumn("_b", F.pmod(F.xxhash64("row_id"), F.lit(n)).cast("int"))
    asked = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = asked.join(blocks, "_b").where(allowed).select("query_id", "_b", "row_id", distance.alias("dist"))
    near = lambda *by: Window.partitionBy(*by).orderBy("dist", "row_id")
    own = met.withColumn("_r", F.row_number().over(near("query_id", "_b"))).where(F.col("_r") <= k)
    return own.withColumn("rank", F.row_number().over(near("query_id"))).where(F.col("rank") <= k).select("query_id", "rank", "row_id", "dist")
