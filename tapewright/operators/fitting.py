"""Penalised fits of log-odds offsets to given class probabilities, by passes over a distributed table.

Each step of the optimiser is one pass: tasks sum the gradients of all models (every ridge value) over their rows, Spark adds the tasks' sums, and the
driver moves a handful of coefficients. No row reaches the driver, and the number of passes is the number of steps plus two, one for the scaling
and one to write the columns that the steps read.

Rows in which the label, a probability or a feature is missing or no number take no part. An empty table gives coefficients of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.functions import probability
from tapewright.operators.statistics import CLASSES, losses
from tapewright.storage import stored

#: Steps of the optimiser, its rate, its decays and the largest gradient that counts.
STEPS, RATE = 80, 0.03
EVIDENCE_STEPS, EVIDENCE_RATE = 300, 0.04
FIRST_DECAY, SECOND_DECAY, SMALL, STEEPEST = 0.9, 0.999, 1e-8, 10.0
#: Fixed value: penalties that are tried.
RIDGES = (0.1, 1.0, 10.0)
#: Fixed value: the difference by which evidence is moved for a numerical gradient.
NUDGE = 1e-5
PROBABILITIES = ("p_tp", "p_sl", "p_expiry")
LEAST = 1e-15

#: Of a batch (columns as matrices) and coefficients (models, causes, names): summed gradients of the same shape and summed losses by model.
Gradient = Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Fit:
    """Coefficients (ridges, causes, names) on standardised features, and the mean penalised loss before each step (steps, ridges)."""

    names: tuple[str, ...]
    ridges: tuple[float, ...]
    means: np.ndarray
    scales: np.ndarray
    coefficients: np.ndarray
    losses: np.ndarray
    rows: int

    def table(self, df: DataFrame) -> DataFrame:
        """ridge, cause, name, coefficient: one row for each."""
        rows = [(r, c, n, float(self.coefficients[i, j, k])) for i, r in enumerate(self.ridges) for j, c in enumerate(CLASSES[:2]) for k, n in enumerate(("intercept", *self.names))]
        return df.sparkSession.createDataFrame(rows, "ridge double, cause string, name string, coefficient double")

    def offsets(self, ridge: int) -> list[Column]:
        """The log-odds of the causes as columns of a table with the features; of the third class 0."""
        z = [F.lit(1.0), *[(F.col(n) - float(m)) / float(s) for n, m, s in zip(self.names, self.means, self.scales, strict=True)]]
        return [sum((float(b) * x for b, x in zip(self.coefficients[ridge, j], z, strict=True)), F.lit(0.0)) for j in range(2)] + [F.lit(0.0)]


def usable(rows: DataFrame, columns: list[str]) -> DataFrame:
    good = F.col("label").isin(*CLASSES)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return rows.where(good)


def standardisation(rows: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Means, population deviations (1e-12 at least) and the number of rows, in one pass."""
    seen = rows.agg(F.count("*"), *[F.avg(n) for n in names], *[F.stddev_pop(n) for n in names]).first()
    k = len(names)
    return np.array([x or 0.0 for x in seen[1 : k + 1]]), np.maximum([x or 0.0 for x in seen[k + 1 :]], 1e-12), seen[0]


def prepared(rows: DataFrame, names: list[str], means: np.ndarray, scales: np.ndarray, further: dict[str, Column]) -> DataFrame:
    """What the steps read: the label's number, the standardised features, and further columns."""
    number = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")).cast("int") - 1
    own = [((F.col(n) - float(m)) / float(s)).alias(f"z{i}") for i, (n, m, s) in enumerate(zip(names, means, scales, strict=True))]
    return stored(rows.select(number.alias("label"), *own, *[c.alias(n) for n, c in further.items()]), "fit-rows")


def _pass(rows: DataFrame, gradient: Gradient, coefficients: np.ndarray, names: int, sums: list[Column]) -> np.ndarray:
    """Sums over all rows: the gradients of every coefficient, then the losses of every model."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if not b.num_rows:
                continue
            columns = {}
            for name in b.schema.names:
                a = b.column(name)
                columns[name] = np.array(a.flatten()).reshape(b.num_rows, -1) if pa.types.is_list(a.type) else a.to_numpy(zero_copy_only=False)
            columns["x"] = np.stack([np.ones(b.num_rows), *[columns[f"z{i}"] for i in range(names)]], axis=1)
            g, losses = gradient(columns, coefficients)
            total += np.concatenate([g.ravel(), losses])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{i}" for i in range(width)])

    partial = rows.mapInArrow(run, ", ".join(f"s{i} double" for i in range(width)))
    return np.array([x or 0.0 for x in partial.agg(*sums).collect()[0]])


def descend(rows: DataFrame, names: int, n: int, gradient: Gradient, ridges: tuple[float, ...], steps: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Adam from coefficients of 0: the final coefficients (ridges, causes, names) and the loss before each step."""
    c = np.zeros((len(ridges), 2, names + 1))
    first, second, history = np.zeros_like(c), np.zeros_like(c), []
    weight = np.array(ridges)[:, None, None] / max(1, n) * (np.arange(names + 1) > 0)  # the intercept is free
    columns = [F.sum(f"s{i}") for i in range(c.size + len(ridges))]
    for step in range(1, steps + 1):
        sums = _pass(rows, gradient, c, names, columns) / max(1, n)
        history.append(sums[c.size :] + (weight * c * c / 2).sum(axis=(1, 2)))
        g = np.clip(sums[: c.size].reshape(c.shape) + weight * c, -STEEPEST, STEEPEST)
        first = FIRST_DECAY * first + (1 - FIRST_DECAY) * g
        second = SECOND_DECAY * second + (1 - SECOND_DECAY) * g * g
        c = c - rate * (first / (1 - FIRST_DECAY**step)) / (np.sqrt(second / (1 - SECOND_DECAY**step)) + SMALL)
    return c, np.array(history)


def softmax_gradient(columns: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the given probabilities' logarithms plus linear offsets of the first two classes."""
    x, label = columns["x"], columns["label"]
    base = np.stack([columns[p] for p in PROBABILITIES], axis=1)
    logits = np.repeat(base[:, None, :], len(c), axis=1)
    logits[:, :, :2] += np.einsum("nk,mck->nmc", x, c)
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    own = p[np.arange(len(x)), :, label]
    hit = label[:, None] == np.arange(2)
    return np.einsum("nmc,nk->mck", p[:, :, :2] - hit[:, None, :], x), -np.log(np.maximum(own, LEAST)).sum(axis=0)


def fit_softmax_offset(rows: DataFrame, names: list[str], ridges: tuple[float, ...] = RIDGES, steps: int = STEPS, rate: float = RATE) -> Fit:
    """Offsets to the probabilities p_tp, p_sl, p_expiry of rows with a label, linear in the named features, for all ridges at once.

    Features of several rules are fitted jointly by naming them all.
    """
    rows = usable(rows, [*PROBABILITIES, *names])
    means, scales, n = standardisation(rows, names)
    own = prepared(rows, names, means, scales, {p: F.ln(F.greatest(F.col(p), F.lit(LEAST))) for p in PROBABILITIES})
    return Fit(tuple(names), ridges, means, scales, *descend(own, len(names), n, softmax_gradient, ridges, steps, rate), n)


def interval_outcome(h: np.ndarray, eta_tp: np.ndarray, eta_sl: np.ndarray) -> np.ndarray:
    """Probabilities (rows, models, 3) of intervals' hazards (rows, intervals, 3) after evidence (rows, models)."""
    done, alive = np.zeros((*eta_tp.shape, 2)), np.ones(eta_tp.shape)
    w_tp, w_sl = np.exp(eta_tp), np.exp(eta_sl)
    for i in range(h.shape[1]):
        tp, sl, none = h[:, i, 0, None] * w_tp, h[:, i, 1, None] * w_sl, h[:, i, 2, None]
        mass = tp + sl + none
        done[:, :, 0] += alive * tp / mass
        done[:, :, 1] += alive * sl / mass
        alive = alive * none / mass
    return np.concatenate([done, alive[:, :, None]], axis=2)


def evidence_gradient(columns: dict[str, np.ndarray], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of competing risks whose hazards are moved by evidence that is linear in the features; differences in place of derivatives."""
    x, label = columns["x"], columns["label"]
    h = columns["hazards"].reshape(len(x), -1, 3)
    eta = np.einsum("nk,mck->nmc", x, c)

    def loss(tp: float, sl: float) -> np.ndarray:
        p = interval_outcome(h, eta[:, :, 0] + tp, eta[:, :, 1] + sl)
        return -np.log(np.maximum(p[np.arange(len(x)), :, label], LEAST))

    by_tp = (loss(NUDGE, 0) - loss(-NUDGE, 0)) / (2 * NUDGE)
    by_sl = (loss(0, NUDGE) - loss(0, -NUDGE)) / (2 * NUDGE)
    return np.einsum("nmc,nk->mck", np.stack([by_tp, by_sl], axis=2), x), loss(0, 0).sum(axis=0)


def fit_evidence(rows: DataFrame, names: list[str], ridges: tuple[float, ...] = (1.0,), steps: int = EVIDENCE_STEPS, rate: float = EVIDENCE_RATE, intervals: int = 24) -> Fit:
    """Evidence coefficients of competing risks: rows have a label, the barriers' log distances up and down, sigma, and the named features."""
    rows = usable(rows, ["up", "down", "sigma", *names]).where("up > 0 and down > 0 and sigma > 0")
    means, scales, n = standardisation(rows, names)
    hazards = probability.interval_hazards(F.col("up"), F.col("down"), F.col("sigma"), intervals)
    own = prepared(rows, names, means, scales, {"hazards": F.flatten(F.transform(hazards, lambda h: F.array(h["tp"], h["sl"], h["none"])))})
    return Fit(tuple(names), ridges, means, scales, *descend(own, len(names), n, evidence_gradient, ridges, steps, rate), n)


def ridge_scores(fit: Fit, rows: DataFrame, horizon: str) -> DataFrame:
    """ridge, n, log_loss, brier (means over horizons of a horizon's mean) and selected (least log loss, then Brier score, then ridge) on further rows."""
    rows = usable(rows, [*PROBABILITIES, *fit.names])
    base = [F.col(p) for p in PROBABILITIES]
    each = F.array(*[F.struct(F.lit(r).alias("ridge"), *[p.alias(n) for n, p in zip(PROBABILITIES, probability.softmax_offsets(base, fit.offsets(i)), strict=True)]) for i, r in enumerate(fit.ridges)])
    moved = rows.select("label", F.col(horizon).alias("horizon"), F.explode(each).alias("m")).select("label", "horizon", "m.*")
    own = losses(moved).groupBy("ridge", "horizon").agg(F.count("*").alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))
    scores = own.groupBy("ridge").agg(F.sum("n").alias("n"), F.avg("log_loss").alias("log_loss"), F.avg("brier").alias("brier"))
    best = scores.agg(F.min(F.struct("log_loss", "brier", "ridge")).alias("b"))  # a row for each ridge
    return scores.crossJoin(F.broadcast(best)).select("ridge", "n", "log_loss", "brier", (F.col("ridge") == F.col("b.ridge")).alias("selected"))
