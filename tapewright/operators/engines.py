"""Probabilities of plans from what followed in like situations: nearest analogs, replayed against a plan's own barriers, stage by stage."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.operators.analogs import Boxes
from tapewright.operators.audits import frontier_step
from tapewright.storage import stored

#: Analogs that count, and ranked candidates that are looked at to find them.
NEIGHBOURS, SCANNED = 16, 64
#: The least width of the kernel, and the prior of each class.
LEAST_WIDTH, PRIOR = 0.25, 0.5
#: Draws of a plan's ranges, and the quantiles reported.
DRAWS, QUANTILES = 1200, (0.025, 0.975)
CLASSES = ("tp", "sl", "none")


def stage_label(tp_step: Column, sl_step: Column, start: int, end: int) -> Column:
    """What an analog's path did in a stage (start, end]: tp, sl, none, ambiguous (both in one step), or null if it was decided before."""
    first = F.least(tp_step, sl_step)  # nulls don't count
    return F.when(first <= start, F.lit(None)).when(first.isNull() | (first > end), "none").when(tp_step.eqNullSafe(sl_step), "ambiguous").when(tp_step.eqNullSafe(first), "tp").otherwise("sl")


def stage_analogs(tree: Boxes, asked: DataFrame, paths: DataFrame, start: int, end: int, penalty: float, neighbours: int = NEIGHBOURS, scanned: int = SCANNED) -> DataFrame:
    """query_id, dist and label of the nearest analogs whose paths were open when the stage began and are clear.

    asked: query_id, symbol, at_ms, v, up, down (log distances of target and stop); paths: row_id, favourable, adverse (frontiers of (level, step)).
    """
    near = tree.nearest(asked, scanned, penalty).join(asked.select("query_id", "up", "down"), "query_id").join(paths, "row_id")
    label = stage_label(frontier_step(F.col("favourable"), F.col("up")), frontier_step(F.col("adverse"), F.col("down")), start, end)
    fit = near.withColumn("label", label).where("label in ('tp', 'sl', 'none')")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return fit.withColumn("_n", place).where(F.col("_n") <= neighbours).select("query_id", "dist", "label")


def stage_posterior(found: DataFrame) -> DataFrame:
    """query_id, n, width and alpha (weights of tp, sl, none plus the prior): analogs weigh by a normal kernel as wide as the furthest of them."""
    width = F.greatest(F.lit(LEAST_WIDTH), F.max("dist").over(Window.partitionBy("query_id")))
    weighed = found.withColumn("width", width).withColumn("w", F.exp(-0.5 * (F.col("dist") / F.col("width")) ** 2))
    alpha = F.array(*[F.sum(F.when(F.col("label") == c, F.col("w")).otherwise(0.0)) + PRIOR for c in CLASSES])
    return weighed.groupBy("query_id").agg(F.count("*").cast("long").alias("n"), F.max("width").alias("width"), alpha.alias("alpha"))


def tempered(alpha: Column, temperature: float) -> Column:
    """Class probabilities (an array) of posterior weights, raised to 1 / temperature."""
    mass = alpha[0] + alpha[1] + alpha[2]
    raised = [F.pow(alpha[i] / mass, F.lit(1 / temperature)) if temperature != 1 else alpha[i] / mass for i in range(3)]
    total = raised[0] + raised[1] + raised[2]
    return F.array(*[x / total for x in raised])


def empirical(asked: DataFrame, trees: dict[str, Boxes], paths: DataFrame, bounds: dict[str, tuple[int, int]], penalty: float = 0.15, temperature: float = 1.0) -> DataFrame:
    """query_id and, for each stage, n_, alpha_, tp_, sl_, none_: the stages' analogs and posteriors, and first-touch probabilities up to their ends.

    asked has a vector v_ for each stage besides query_id, symbol, at_ms, up and down; trees hold the same stage's vectors. A stage without analogs has the
    prior alone. Only what survives a stage enters the next one.
    """
    out = asked.select("query_id")
    for name, (start, end) in bounds.items():
        found = stage_analogs(trees[name], asked.select("query_id", "symbol", "at_ms", F.col(f"v_{name}").alias("v"), "up", "down"), paths, start, end, penalty)
        own = stored(stage_posterior(found), "engine-stage").select("query_id", F.col("n").alias(f"n_{name}"), F.col("alpha").alias(f"alpha_{name}"))
        out = out.join(own, "query_id", "left")
    tp, sl, alive = F.lit(0.0), F.lit(0.0), F.lit(1.0)
    for name in bounds:
        prior = F.array(*[F.lit(PRIOR)] * 3)
        out = out.withColumns({f"n_{name}": F.coalesce(f"n_{name}", F.lit(0).cast("long")), f"alpha_{name}": F.coalesce(f"alpha_{name}", prior)})
        out = out.withColumn("_p", tempered(F.col(f"alpha_{name}"), temperature))
        out = out.withColumns({f"tp_{name}": tp + alive * F.col("_p")[0], f"sl_{name}": sl + alive * F.col("_p")[1]}).withColumn(f"none_{name}", 1 - F.col(f"tp_{name}") - F.col(f"sl_{name}")).drop("_p")
        tp, sl, alive = F.col(f"tp_{name}"), F.col(f"sl_{name}"), F.col(f"none_{name}")
    return out


def cumulative_draws(key: str, alphas: np.ndarray, draws: int = DRAWS, temperature: float = 1.0) -> np.ndarray:
    """Draws (draws, 3) of the last stage's first-touch probabilities from the stages' posteriors; they depend on the key and the posteriors alone."""
    rng = np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(key.encode()).digest()[:16], "big")))
    done, alive = np.zeros((draws, 2)), np.ones((draws, 1))
    for alpha in alphas:
        p = rng.standard_gamma(alpha, (draws, 3))
        p = (p / p.sum(axis=1, keepdims=True)) ** (1 / temperature)
        p /= p.sum(axis=1, keepdims=True)
        done, alive = done + alive * p[:, :2], alive * p[:, 2:]
    return np.concatenate([done, alive], axis=1)


def empirical_ranges(posteriors: DataFrame, stages: list[str], draws: int = DRAWS, temperature: float = 1.0) -> DataFrame:
    """query_id and low and high of each class up to the last stage, by draws from the stages' posteriors (query_id, alpha_ of each stage)."""
    columns = [f"{c}_{side}" for c in CLASSES for side in ("low", "high")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            alphas = np.stack([np.array(b.column(f"alpha_{s}").flatten()).reshape(-1, 3) for s in stages], axis=1)
            found = []
            for key, own in zip(b.column("query_id").to_pylist(), alphas, strict=True):
                drawn = np.sort(cumulative_draws(key, own, draws, temperature), axis=0)
                at = [min(draws - 1, int(draws * q)) for q in QUANTILES]
                found.append([float(drawn[i, c]) for c in range(3) for i in at])
            yield pa.RecordBatch.from_arrays([b.column("query_id"), *(pa.array([r[i] for r in found], pa.float64()) for i in range(6))], ["query_id", *columns])

    return posteriors.select("query_id", *[f"alpha_{s}" for s in stages]).mapInArrow(run, "query_id string, " + ", ".join(f"{c} double" for c in columns))


# ---- an independent solver


def finite_differences(up: np.ndarray, down: np.ndarray, sigma: np.ndarray, cells: int = 240, steps: int = 1200) -> np.ndarray:
    """Probabilities (rows, 3) of touching the upper or the lower barrier first, or neither, by implicit differences of the heat equation.

    All rows share the grid's shape, so each step solves one tridiagonal system for all of them at once by elimination and back substitution.
    """
    ratio = sigma * sigma / 2 / steps / ((up + down) / cells) ** 2
    n = cells - 1
    scaled, pivots = np.zeros((n, len(up))), np.zeros((n, len(up)))
    before = np.zeros(len(up))
    for i in range(n):
        pivots[i] = 1 / (1 + 2 * ratio + ratio * before)
        before = scaled[i] = -ratio * pivots[i]
    # both barriers' chances side by side: 1 at the barrier itself, 0 at the other one
    now = np.zeros((n, 2, len(up)))
    for _ in range(steps):
        now[-1, 0] += ratio
        now[0, 1] += ratio
        now[0] *= pivots[0]
        for i in range(1, n):
            now[i] = (now[i] + ratio * now[i - 1]) * pivots[i]
        for i in range(n - 2, -1, -1):
            now[i] -= scaled[i] * now[i + 1]
    at = down / ((up + down) / cells)
    low = np.minimum(at.astype(int), cells - 1)
    share, rows = at - low, np.arange(len(up))
    whole = np.concatenate([np.stack([np.zeros(len(up)), np.ones(len(up))])[None], now, np.stack([np.ones(len(up)), np.zeros(len(up))])[None]])
    p = (1 - share) * whole[low, :, rows].T + share * whole[low + 1, :, rows].T
    return np.stack([p[0], p[1], np.maximum(0.0, 1 - p[0] - p[1])], axis=1)


def solved_by_differences(plans: DataFrame, key: str, cells: int = 240, steps: int = 1200) -> DataFrame:
    """key, p_tp, p_sl, p_expiry of plans (key, up, down, sigma) by finite differences; null for distances or a sigma that are not positive and finite."""
    kind = plans.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("up", "down", "sigma")]
            good = np.all([np.isfinite(v) & (np.nan_to_num(v) > 0) for v in x], axis=0)
            p = np.full((b.num_rows, 3), np.nan)
            if good.any():
                p[good] = finite_differences(*[v[good] for v in x], cells, steps)
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(p[:, i], pa.float64(), from_pandas=True) for i in range(3))], [key, "p_tp", "p_sl", "p_expiry"])

    return plans.select(key, "up", "down", "sigma").mapInArrow(run, f"`{key}` {kind}, p_tp double, p_sl double, p_expiry double")
