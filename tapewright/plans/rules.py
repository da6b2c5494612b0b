"""Rules as columns: each rule is a struct of status, reason and outputs, in dependency order.

A rule whose parents are not all evaluated is blocked; so is one with a null or non-finite output. Rules stay
column expressions, so a set of them is one projection over windowed bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import log_distances
from tapewright.operators.indicators import back, changes, midrank


def traced(name: str, outputs: dict[str, Column], parents: list[str], guard: Column | None = None, reason: str = "invalid_input") -> Column:
    """A rule's trace; guard false or null blocks it for the given reason."""
    ready = F.lit(True)
    for p in parents:
        ready = ready & (F.col(p)["status"] == "evaluated")
    good = F.coalesce(guard, F.lit(False)) if guard is not None else F.lit(True)
    finite = F.lit(True)
    for c in outputs.values():
        finite = finite & F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False))
    status = F.when(ready & good & finite, "evaluated").otherwise("blocked")
    why = F.when(~ready, "dependency_not_evaluated").when(~good, reason).when(~finite, "output_not_finite")
    return F.struct(status.alias("status"), why.alias("reason"), *[F.when(ready & good & finite, c).alias(n) for n, c in outputs.items()]).alias(name)


def core_rules(bars: DataFrame, horizon: int = 24, reference: int = 10) -> DataFrame:
    """Traces of the structure rules at every bar, for a long plan with the bar's own levels.

    bars have entry, stop and target besides prices.
    """
    up, down = log_distances(F.lit("long"), F.col("entry"), F.col("stop"), F.col("target"))
    df = changes(bars)
    frame = back(horizon)
    df = df.withColumn("_var", F.sum(F.col("ret") ** 2).over(frame)).withColumn("_moved", F.sum("ret").over(frame)).withColumn("_path", F.sum(F.abs("ret")).over(frame)).withColumn("_half", F.sum("ret").over(back(horizon // 2)))
    df = df.withColumn("_top", F.max("high").over(back(horizon))).withColumn("_bottom", F.min("low").over(back(horizon)))
    before = Window.partitionBy("symbol", "_phase").orderBy("open_ms").rowsBetween(-reference, -1)
    df = df.withColumn("_phase", F.col("n") % horizon).withColumn("_ref", F.collect_list(F.when(F.col("n") > horizon, F.col("_var"))).over(before))
    df = df.withColumn("plan_geometry", traced("plan_geometry", {"up": up, "down": down, "reward_risk": up / down}, [], (F.col("stop") < F.col("entry")) & (F.col("entry") < F.col("target")), "invalid_geometry"))
    df = df.withColumn("realized_volatility", traced("realized_volatility", {"variance": F.col("_var"), "sigma": F.sqrt("_var")}, [], (F.col("n") > horizon) & (F.col("_var") > 0), "not_enough_bars"))
    df = df.withColumn("normalized_barriers", traced("normalized_barriers", {"z_tp": F.col("plan_geometry.up") / F.col("realized_volatility.sigma"), "z_sl": F.col("plan_geometry.down") / F.col("realized_volatility.sigma")}, ["plan_geometry", "realized_volatility"]))
    df = df.withColumn("path_structure", traced("path_structure", {"displacement": F.col("_moved"), "efficiency": F.col("_moved") / F.col("_path")}, ["realized_volatility"], F.col("_path") > 0, "no_variation"))
    df = df.withColumn("prior_extrema", traced("prior_extrema", {"top": F.col("_top"), "bottom": F.col("_bottom"), "between": ((F.col("target") >= F.col("_top")) & (F.col("entry") < F.col("_top"))).cast("int")}, ["plan_geometry"]))
    df = df.withColumn("volatility_rank", traced("volatility_rank", {"midrank": midrank(F.col("_var"), F.col("_ref"))}, ["realized_volatility"], F.size("_ref") == reference, "reference_too_short"))
    df = df.withColumn("hierarchy", traced("hierarchy", {"agreement": (F.signum("_moved") == F.signum("_half")).cast("int")}, ["path_structure"]))
    df = df.withColumn("regime", traced("regime", {"volatility": F.col("volatility_rank.midrank"), "efficiency": F.col("path_structure.efficiency")}, ["volatility_rank", "path_structure"]))
    names = ["plan_geometry", "realized_volatility", "normalized_barriers", "path_structure", "prior_extrema", "volatility_rank", "hierarchy", "regime"]
    return df.select("symbol", "open_ms", *names)


def rule_counts(traces: DataFrame, names: list[str]) -> DataFrame:
    """rule, status, reason and count of a table of traces."""
    rows = traces.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n)["status"].alias("status"), F.coalesce(F.col(n)["reason"], F.lit("-")).alias("reason")) for n in names])).alias("t")).select("t.*")
    return rows.groupBy("rule", "status", "reason").agg(F.count("*").alias("n"))
