"""What a score's components are worth: every case is replayed with each component left out in turn.

A case carries its components as one array. The replays are transforms of that array with one place set to 0, so no case is scored by a join or a
second pass; the differences leave a row for each component, and are summed by component before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the probabilities on their way, and the least difference that counts as a change.
START, FIRST, LAST, WIDE, LEAST_SL = 0.5, (0.26, 0.74), (0.22, 0.74), (0.04, 0.22), 0.05
MOST_RANGE, CHANGE = 0.20, 0.0001


def held(x: Column, limits: tuple[float, float]) -> Column:
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), x))


def replayed(values: Column, signs: list[float], contradiction: int, regime: Column, range_pct: Column) -> Column:
    """struct(tp, sl, range) of an array of components: those that move the target's probability, with their signs, then its late adjustment, then
    the two of the range. contradiction is the place of the component that widens the range."""
    n = len(signs)
    score = F.lit(START)
    for i, sign in enumerate(signs):
        score = score + sign * values[i]
    tp = held(held(score, FIRST) + values[n], LAST)
    base = F.when(regime.isin("compresion", "mixto"), 0.12).when(values[contradiction] >= 0.03, 0.10).when(range_pct < 1.2, 0.08).otherwise(0.06)
    middle = held(F.least(F.lit(MOST_RANGE), base + values[n + 1]) + values[n + 2], WIDE)
    return F.struct(tp.alias("tp"), F.greatest(F.lit(LEAST_SL), 1 - tp - middle).alias("sl"), middle.alias("range"))


def ablations(cases: DataFrame, units: list[str], signs: list[float], contradiction: str) -> DataFrame:
    """unit, cases, active, how many cases' probabilities and sign of expected value change, and sums and maxima of the changes.

    cases: components (array in the order of units, nulls count as 0), regime, range_pct, win, loss, cost.
    """
    place = units.index(contradiction)
    value = lambda p: p["tp"] * F.col("win") - p["sl"] * F.col("loss") - p["range"] * F.col("cost")
    known = cases.withColumn("components", F.transform("components", lambda x: F.coalesce(x, F.lit(0.0))))
    whole = known.withColumn("whole", replayed(F.col("components"), signs, place, F.col("regime"), F.col("range_pct")))
    every = F.array(*[F.struct(F.lit(u).alias("unit"), F.lit(i).alias("i")) for i, u in enumerate(units)])
    rows = whole.withColumn("ev", value(F.col("whole"))).withColumn("u", F.explode(every))
    without = F.transform("components", lambda x, i: F.when(i == F.col("u.i"), 0.0).otherwise(x))
    rows = rows.withColumn("own", replayed(without, signs, place, F.col("regime"), F.col("range_pct")))
    change = lambda n: F.abs(F.col(f"own.{n}") - F.col(f"whole.{n}"))
    by_ev = value(F.col("own"))
    active = F.element_at("components", F.col("u.i") + 1) != 0
    flips = ((F.col("ev") >= 0) & (by_ev < 0)) | ((F.col("ev") < 0) & (by_ev >= 0))
    return rows.groupBy("u.unit").agg(
        F.count("*").alias("cases"),
        F.count_if(active).alias("active"),
        *[F.count_if(change(n) >= CHANGE).alias(f"{n}_changed") for n in ("tp", "sl", "range")],
        F.count_if(flips).alias("ev_sign_changed"),
        F.sum(change("tp")).alias("sum_tp"),
        F.max(change("tp")).alias("max_tp"),
        F.sum(F.abs(by_ev - F.col("ev"))).alias("sum_ev"),
        F.max(F.abs(by_ev - F.col("ev"))).alias("max_ev"),
    )
