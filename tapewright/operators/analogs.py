"""Exact nearest neighbours among earlier rows, by a tree of bounding boxes.

Rows are sorted by symbol and a Z-order code of their vectors and cut into cells of CELL_ROWS consecutive rows; FANOUT consecutive cells
make a node, as many of these a node of the next level, up to a top of FANOUT nodes at most. Each node knows the box, the first time and the
symbols of its rows, so no row in it is nearer to a query than its box is. A query first goes down to the BEAM nearest cells, whose rows bound the distance of
its k-th neighbour; then it goes down again to every node within that bound, and only rows of cells within it are compared. Going down a level is an
equi-join on the node, so neither queries nor nodes are ever paired as a whole. The order of the sort decides how much is pruned, never the result.

Distances are the root of the mean squared difference, each square at most CAP, plus a penalty for another symbol. Vectors hold numbers only; rows and
queries with a null or a non-finite component have no neighbours and are none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.storage import stored

CELL_ROWS = 256
FANOUT = 64
#: Nodes of a level that a query goes down by in search of a first bound.
BEAM = 4
#: Fixed value: the most that one squared difference counts.
CAP = 36.0


def sound(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def distance(left: Column, right: Column, size: int) -> Column:
    """Of two vectors, written out so that it runs in generated code."""
    total = F.lit(0.0)
    for i in range(size):
        gap = left[i] - right[i]
        total = total + F.least(F.lit(CAP), gap * gap)
    return F.sqrt(total / size)


def box_distance(v: Column, low: Column, high: Column, size: int) -> Column:
    total = F.lit(0.0)
    for i in range(size):
        gap = F.greatest(low[i] - v[i], v[i] - high[i], F.lit(0.0))
        total = total + F.least(F.lit(CAP), gap * gap)
    return F.sqrt(total / size)


def z_order(rows: DataFrame, size: int) -> Column:
    """A code of vectors whose components are placed within three deviations of their mean; bits of all components by turns."""
    seen = rows.agg(*[F.avg(F.col("v")[i]) for i in range(size)], *[F.stddev_pop(F.col("v")[i]) for i in range(size)]).first()
    bits = max(1, min(10, 60 // size))
    code = F.lit(0).cast("long")
    for i in range(size):
        mean, dev = float(seen[i] or 0.0), max(float(seen[size + i] or 0.0), 1e-12)
        place = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("v")[i] - mean) / dev + 3) / 6)) * ((1 << bits) - 1)).cast("long")
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1).cast("long")), b * size + i))
    return code


class Boxes:
    """The tree over rows (row_id, symbol, at_ms, v); levels go from the top to the cells."""

    def __init__(self, rows: DataFrame, size: int, cell_rows: int = CELL_ROWS) -> None:
        rows, self.size = rows.select("row_id", "symbol", "at_ms", "v").where(sound("v")), size
        sorted_rows = rows.withColumn("z", z_order(rows, size)).repartitionByRange("symbol", "z").sortWithinPartitions("symbol", "z", "row_id").drop("z")
        # a row's number in its partition, fixed once it is written
        numbered = stored(sorted_rows.withColumn("i", F.monotonically_increasing_id()), "analog-rows")
        part, at = F.shiftright("i", 33), F.col("i").bitwiseAND(F.lit((1 << 33) - 1))
        ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        parts = numbered.groupBy(part.alias("part")).agg(F.ceil(F.count("*") / cell_rows).alias("cells"))
        parts = parts.select("part", F.coalesce(F.sum("cells").over(ahead), F.lit(0)).cast("long").alias("first"))
        placed = numbered.withColumn("part", part).join(F.broadcast(parts), "part")
        self.rows = placed.select("row_id", "symbol", "at_ms", "v", (F.col("first") + (at / cell_rows).cast("long")).alias("node"))
        span = [f(F.col("v")[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(size)]
        cells = self.rows.groupBy("node").agg(F.min("at_ms").alias("at_ms"), F.min("symbol").alias("symbol_low"), F.max("symbol").alias("symbol_high"), *span)
        corner = lambda n: F.array(*[F.col(f"{n}{i}") for i in range(size)]).alias(n)
        up = lambda df: df.withColumn("parent", (F.col("node") / FANOUT).cast("long"))
        self.levels = [stored(up(cells.select("node", "at_ms", "symbol_low", "symbol_high", corner("low"), corner("high"))), "analog-cells")]
        while (count := self.levels[0].agg(F.max("node")).first()[0]) is not None and count >= FANOUT:
            each = [f(F.col(n)[i]).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(size)]
            above = self.levels[0].groupBy(F.col("parent").alias("node")).agg(F.min("at_ms").alias("at_ms"), F.min("symbol_low").alias("symbol_low"), F.max("symbol_high").alias("symbol_high"), *each)
            self.levels.insert(0, stored(up(above.select("node", "at_ms", "symbol_low", "symbol_high", corner("low"), corner("high"))), "analog-nodes"))

    def _below(self, asked: DataFrame, level: int, penalty: float) -> DataFrame:
        """asked (query_id, q_symbol, q_ms, q, bound, node) once for each child within the bound, with the child's distance as least."""
        nodes = self.levels[level].select(F.col("node").alias("child"), "parent", "at_ms", "symbol_low", "symbol_high", "low", "high")
        met = asked.join(nodes, asked.node == nodes.parent).where("at_ms < q_ms")
        other = F.when((F.col("q_symbol") < F.col("symbol_low")) | (F.col("q_symbol") > F.col("symbol_high")), penalty).otherwise(0.0)
        out = met.withColumn("least", box_distance(F.col("q"), F.col("low"), F.col("high"), self.size) + other)
        # sums of the box and of rows may round apart
        return out.where(F.col("least") <= F.col("bound") + 1e-9).select("query_id", "q_symbol", "q_ms", "q", "bound", F.col("child").alias("node"), "least")

    def _compared(self, asked: DataFrame, penalty: float) -> DataFrame:
        met = asked.drop("least").join(self.rows, "node").where("at_ms < q_ms")
        other = F.when(F.col("q_symbol") == F.col("symbol"), 0.0).otherwise(penalty)
        return met.select("query_id", "q_symbol", "q_ms", "q", "bound", "row_id", (distance(F.col("q"), F.col("v"), self.size) + other).alias("dist"))

    def pairs(self, queries: DataFrame, k: int, penalty: float = 0.0) -> DataFrame:
        """query_id, row_id, dist of the rows in cells within each query's bound: all that are compared in the end."""
        asked = queries.where(sound("v")).select("query_id", F.col("symbol").alias("q_symbol"), F.col("at_ms").alias("q_ms"), F.col("v").alias("q"))
        first = asked.withColumn("bound", F.lit(float("inf"))).withColumn("node", F.lit(0).cast("long"))
        # the top level is the only child level of an imagined root
        for level in range(len(self.levels)):
            each = Window.partitionBy("query_id").orderBy("least", "node")
            first = self._below(first, level, penalty).withColumn("_r", F.row_number().over(each)).where(F.col("_r") <= BEAM).drop("_r", "least")
        near = self._compared(first, penalty).withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "row_id"))).where(F.col("_r") == k)
        bounds = near.select("query_id", F.col("dist").alias("bound"))
        within = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).withColumn("node", F.lit(0).cast("long"))
        for level in range(len(self.levels)):
            within = self._below(within, level, penalty)
        return self._compared(within, penalty).select("query_id", "row_id", "dist")

    def nearest(self, queries: DataFrame, k: int, penalty: float = 0.0) -> DataFrame:
        """query_id, rank, row_id, dist: the k nearest earlier rows of each query (query_id, symbol, at_ms, v), ties to the smaller row_id."""
        order = Window.partitionBy("query_id").orderBy("dist", "row_id")
        ranked = self.pairs(queries, k, penalty).withColumn("rank", F.row_number().over(order))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "row_id", "dist")


def expected_levels(rows: int, cell_rows: int = CELL_ROWS) -> int:
    """Levels of a tree over so many rows: they grow with the logarithm."""
    return max(1, math.ceil(math.log(max(2, math.ceil(rows / cell_rows)), FANOUT)))
