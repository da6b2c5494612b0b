"""Contexts of bars at several scales, and probabilities that are chained over stages of time.

Each scale is a multiple of the one before. Sums and extremes of the smallest scale come from one frame; those of a larger scale are merged from the last
ones of the scale below, so a bar costs as many steps as the scales have factors (4 + 6 + 7 for 4, 24 and 168 bars) and not as they have bars. All
frames share one exchange and one sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import probability
from tapewright.operators.indicators import back, by_time, changes

#: Stages with their bars: hours of the horizons.
SCALES = {"4h": 4, "24h": 24, "7d": 168}
PARTS = ("rv", "disp", "var", "vol", "high", "low")


def contexts(bars: DataFrame, scales: dict[str, int] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, open_ms, close and for each scale sigma, efficiency (signed), place (of the close between low and high), activity (the
    logarithm of the volume of a bar over that of the longest scale), high and low; only bars with a full longest scale of returns."""
    scales = scales or SCALES
    names, sizes = list(scales), list(scales.values())
    w, df, step = by_time(), changes(bars).withColumn("path", F.abs("ret")).withColumn("square", F.col("ret") * F.col("ret")), 1
    frame = back(sizes[0])
    df = df.withColumns(
        {
            f"rv_{names[0]}": F.sum("square").over(frame),
            f"disp_{names[0]}": F.sum("ret").over(frame),
            f"var_{names[0]}": F.sum("path").over(frame),
            f"vol_{names[0]}": F.sum("volume").over(frame),
            f"high_{names[0]}": F.max("high").over(frame),
            f"low_{names[0]}": F.min("low").over(frame),
        }
    )
    for last, name in zip(names[:-1], names[1:], strict=True):
        step, times = scales[last], scales[name] // scales[last]
        if scales[name] % scales[last]:
            raise ValueError("each scale has to be a multiple of the one before")
        merged = {}
        for part in PARTS:
            pieces = [F.col(f"{part}_{last}") if i == 0 else F.lag(f"{part}_{last}", i * step).over(w) for i in range(times)]
            merged[f"{part}_{name}"] = F.greatest(*pieces) if part == "high" else F.least(*pieces) if part == "low" else reduce(lambda a, b: a + b, pieces)
        df = df.withColumns(merged)
    longest, size = names[-1], sizes[-1]
    out = []
    for name in names:
        high, low = F.col(f"high_{name}"), F.col(f"low_{name}")
        out += [
            F.sqrt(f"rv_{name}").alias(f"sigma_{name}"),
            F.when(F.col(f"var_{name}") > 0, F.col(f"disp_{name}") / F.col(f"var_{name}")).otherwise(0.0).alias(f"efficiency_{name}"),
            F.when(high > low, (F.col("close") - low) / (high - low)).otherwise(0.5).alias(f"place_{name}"),
            F.ln((F.col(f"vol_{name}") / scales[name]) / (F.col(f"vol_{longest}") / size)).alias(f"activity_{name}"),
            high.alias(f"high_{name}"),
            low.alias(f"low_{name}"),
        ]
    return df.where(F.col("n") > size).select("symbol", "open_ms", "n", "close", *keep, *out)


def target_between(side: Column, entry: Column, target: Column, high: Column, low: Column) -> Column:
    """Whether a scale's extreme on the target's side lies between entry and target."""
    return F.when(side == "long", (entry < high) & (high < target)).otherwise((target < low) & (low < entry))


def conditional_of(curve: list[Column]) -> list[Column]:
    """Conditional stages struct(tp, sl, none) of cumulative ones struct(p_tp, p_sl, p_expiry); the last class is certain once nothing survives."""
    out = []
    for i, now in enumerate(curve):
        tp, sl, alive = (curve[i - 1][n] if i else F.lit(x) for n, x in (("p_tp", 0.0), ("p_sl", 0.0), ("p_expiry", 1.0)))
        parts = [F.greatest(F.lit(0.0), x) / alive for x in (now["p_tp"] - tp, now["p_sl"] - sl, now["p_expiry"])]
        mass = parts[0] + parts[1] + parts[2]
        spent = F.struct(F.lit(0.0).alias("tp"), F.lit(0.0).alias("sl"), F.lit(1.0).alias("none"))
        out.append(F.when(alive <= 1e-12, spent).otherwise(F.struct(*[(x / mass).alias(n) for x, n in zip(parts, ("tp", "sl", "none"), strict=True)])))
    return out


def sequential(plans: DataFrame, models: dict[str, dict[str, dict[str, tuple[float, float, float]]]], scales: dict[str, int] | None = None) -> DataFrame:
    """plans (up, down, sigma and features of each scale) with tp_, sl_ and none_ of each scale: first-touch probabilities up to the stage's end.

    The baseline's variance grows by each stage's own sigma for the hours that the stage adds. Conditional stages are moved by a stage's model:
    of each cause (tp, sl) a map from feature (the intercept, or a column's name without the scale) to coefficient, mean and deviation; a stage without a model
    keeps its baseline. A model of a stage can use the features of its own and earlier stages only, so later stages never change earlier ones.
    """
    scales = scales or SCALES
    df, variance, curve, before = plans, F.lit(0.0), [], 0
    for name, size in scales.items():
        variance = variance + F.col(f"sigma_{name}") * F.col(f"sigma_{name}") * ((size - before) / size)
        df = df.withColumn(f"_b_{name}", probability.double_barrier(F.col("up"), F.col("down"), F.sqrt(variance)))
        curve.append(F.col(f"_b_{name}"))
        before = size
    df = df.withColumns({f"_c_{name}": c for name, c in zip(scales, conditional_of(curve), strict=True)})
    tp, sl, alive = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    for name in scales:
        base = [F.col(f"_c_{name}")[n] for n in ("tp", "sl", "none")]
        offsets = []
        for cause in ("tp", "sl"):
            terms = [F.lit(c) if f == "intercept" else c * (F.col(f) - m) / s for f, (c, m, s) in models.get(name, {}).get(cause, {}).items()]
            offsets.append(reduce(lambda a, b: a + b, terms, F.lit(0.0)))
        p = probability.softmax_offsets(base, [*offsets, F.lit(0.0)]) if name in models else base
        df = df.withColumn(f"_p_{name}", F.array(*p))
        own = F.col(f"_p_{name}")
        df = df.withColumns({f"tp_{name}": tp + alive * own[0], f"sl_{name}": sl + alive * own[1]}).withColumn(f"none_{name}", 1 - F.col(f"tp_{name}") - F.col(f"sl_{name}"))
        tp, sl, alive = F.col(f"tp_{name}"), F.col(f"sl_{name}"), F.col(f"none_{name}")
    return df.drop(*[f"_{x}_{name}" for x in "bcp" for name in scales])
