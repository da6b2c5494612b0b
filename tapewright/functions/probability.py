"""First-passage probabilities of driftless diffusions as column expressions.

The absorbing interval has the eigenfunction series in exp(-n^2); its length follows from the interval's width in standard
deviations, so each row sums as many terms as it needs, inside Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def double_barrier(up: Column, down: Column, sigma: Column, fraction: Column | None = None) -> Column:
    """struct(p_tp, p_sl, p_expiry): which of two barriers at logarithmic distances up and down is touched first.

    sigma is the deviation over the whole horizon, fraction the part of it that has passed (default 1). Null for distances or a
    sigma that are not positive and finite.
    """
    own = sigma if fraction is None else sigma * F.sqrt(fraction)
    width = up + down
    decay = F.lit(math.pi**2 / 2) * own * own / (width * width)
    terms = F.greatest(F.lit(8), F.ceil(F.sqrt(F.lit(31.0) / decay))).cast("int")
    theta = F.lit(math.pi) * down / width
    steps = F.sequence(F.lit(1), terms)
    part = lambda n: F.sin(n * theta) * F.exp(-decay * n * n) / n
    total = lambda f: F.aggregate(steps, F.lit(0.0), lambda acc, n: acc + f(n))
    low = total(part)
    high = total(lambda n: F.when(n % 2 == 1, part(n)).otherwise(-part(n)))
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    p_up = clip(down / width - F.lit(2 / math.pi) * high)
    p_down = clip(up / width - F.lit(2 / math.pi) * low)
    good = (up > 0) & (down > 0) & (sigma > 0) & (width < float("inf"))
    moved = F.struct(p_up.alias("p_tp"), p_down.alias("p_sl"), clip(1 - p_up - p_down).alias("p_expiry"))
    still = F.struct(F.lit(0.0).alias("p_tp"), F.lit(0.0).alias("p_sl"), F.lit(1.0).alias("p_expiry"))
    return F.when(good & (own > 0), moved).when(good, still)


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution: a series of positive terms, which loses no digits, within 9 deviations; 0 and 1 beyond."""
    z = F.abs(x)
    start = F.struct(z.alias("term"), z.alias("sum"))
    step = lambda acc, k: let(acc["term"] * z * z / (2 * k + 1), lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(160)), start, step)["sum"]
    half = F.least(F.lit(0.5), F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * total)
    return F.when(z >= 9, F.when(x > 0, 1.0).otherwise(0.0)).otherwise(0.5 + F.signum(x) * half)


def single_barrier(distance: Column, sigma: Column) -> Column:
    """Probability that one barrier is touched: the other is put where no path comes (40 deviations)."""
    return double_barrier(distance, 40 * sigma, sigma)["p_tp"]


def limit_tree(activation: Column, after: Column) -> Column:
    """Probabilities of a resting order: not filled, and filled times the outcome after it."""
    return F.struct((1 - activation).alias("p_unfilled"), *[(activation * after[n]).alias(n) for n in ("p_tp", "p_sl", "p_expiry")])


def tempered(p: list[Column], temperature: float) -> list[Column]:
    """Probabilities raised to 1 / temperature and scaled to one."""
    raised = [F.pow(F.greatest(x, F.lit(1e-15)), F.lit(1 / temperature)) for x in p]
    mass = sum(raised[1:], raised[0])
    return [x / mass for x in raised]


def softmax_offsets(p: list[Column], offsets: list[Column]) -> list[Column]:
    """Probabilities moved by log-odds offsets."""
    moved = [F.greatest(x, F.lit(1e-15)) * F.exp(o) for x, o in zip(p, offsets, strict=True)]
    mass = sum(moved[1:], moved[0])
    return [x / mass for x in moved]


def interval_hazards(up: Column, down: Column, sigma: Column, intervals: int = 24) -> Column:
    """An array of struct(tp, sl, none): in each of equal intervals, which barrier a path that is still between them touches first."""
    curve = F.transform(F.sequence(F.lit(0), F.lit(intervals)), lambda i: double_barrier(up, down, sigma, i / F.lit(float(intervals))))

    def one(grid: Column, i: Column) -> Column:
        before, after = F.element_at(grid, i), F.element_at(grid, i + 1)
        alive = before["p_expiry"]
        tp = F.when(alive > 1e-10, (after["p_tp"] - before["p_tp"]) / alive).otherwise(0.0)
        sl = F.when(alive > 1e-10, (after["p_sl"] - before["p_sl"]) / alive).otherwise(0.0)
        return F.struct(F.greatest(tp, F.lit(0.0)).alias("tp"), F.greatest(sl, F.lit(0.0)).alias("sl"), F.greatest(1 - tp - sl, F.lit(0.0)).alias("none"))

    return let(curve, lambda grid: F.transform(F.sequence(F.lit(1), F.lit(intervals)), lambda i: one(grid, i)))


def competing_risks(up: Column, down: Column, sigma: Column, eta_tp: Column, eta_sl: Column, intervals: int = 24) -> Column:
    """struct(p_tp, p_sl, p_expiry) after evidence: each interval's cause-specific hazards from the baseline curve, moved by log-odds
    eta, then cumulative incidence."""
    start = F.struct(F.lit(0.0).alias("tp"), F.lit(0.0).alias("sl"), F.lit(1.0).alias("alive"))

    def step(acc: Column, h: Column) -> Column:
        w_tp, w_sl = h["tp"] * F.exp(eta_tp), h["sl"] * F.exp(eta_sl)
        mass = w_tp + w_sl + h["none"]
        return F.struct((acc["tp"] + acc["alive"] * w_tp / mass).alias("tp"), (acc["sl"] + acc["alive"] * w_sl / mass).alias("sl"), (acc["alive"] * h["none"] / mass).alias("alive"))

    out = F.aggregate(interval_hazards(up, down, sigma, intervals), start, step)
    return let(out, lambda o: F.struct(o["tp"].alias("p_tp"), o["sl"].alias("p_sl"), o["alive"].alias("p_expiry")))


# ---- stages and trees


def cumulative_stages(stages: Column) -> Column:
    """Cumulative target, stop and survival after each of an array of conditional stages (tp, sl, none); survival takes up what rounding loses."""
    start = F.array(F.struct(F.lit(0.0).alias("tp"), F.lit(0.0).alias("sl"), F.lit(1.0).alias("none")))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        tp, sl = last["tp"] + last["none"] * s["tp"], last["sl"] + last["none"] * s["sl"]
        return F.concat(acc, F.array(F.struct(tp.alias("tp"), sl.alias("sl"), (1 - tp - sl).alias("none"))))

    return F.slice(F.aggregate(stages, start, step), F.lit(2), F.size(stages))


def conditional_stages(curve: Column) -> Column:
    """The conditional stages (tp, sl, none) of a cumulative curve; null once nothing survives."""

    def one(i: Column) -> Column:
        now = F.element_at(curve, i + 1)
        part = lambda n: now[n] - F.when(i == 0, 0.0).otherwise(F.element_at(curve, F.greatest(i, F.lit(1)))[n])
        alive = F.when(i == 0, 1.0).otherwise(F.element_at(curve, F.greatest(i, F.lit(1)))["none"])
        return F.when(alive > 0, F.struct((part("tp") / alive).alias("tp"), (part("sl") / alive).alias("sl"), (now["none"] / alive).alias("none")))

    return F.transform(F.sequence(F.lit(0), F.size(curve) - 1), one)


def linear_predictor(coefficients: Column, features: Column) -> Column:
    """Intercept plus the sum of coefficient times feature over maps; null where a feature is missing."""
    terms = F.map_filter(coefficients, lambda k, v: k != "intercept")
    total = F.aggregate(F.map_entries(terms), F.lit(0.0), lambda a, e: a + e["value"] * features[e["key"]])
    return total + F.coalesce(coefficients["intercept"], F.lit(0.0))


def contributions(coefficients: Column, features: Column, means: Column, scales: Column) -> Column:
    """Each feature's part of the linear predictor: its coefficient times its standardised value."""
    return F.map_filter(F.transform_values(coefficients, lambda k, c: c * (features[k] - means[k]) / F.nullif(scales[k], F.lit(0.0))), lambda k, v: v.isNotNull())


def pooled(shared: Column, local: Column, n: Column, strength: float) -> Column:
    """Coefficients pooled by n / (n + strength): the more local rows, the more local weight."""
    weight = n / (n + strength)
    return F.transform_values(shared, lambda k, v: weight * local[k] + (1 - weight) * v)


def is_distribution(p: Column, keys: list[str], tolerance: float = 1e-9) -> Column:
    """Whether a map has exactly these keys, no negative or null value, and the sum 1."""
    named = F.array_sort(F.map_keys(p)) == F.array(*map(F.lit, sorted(keys)))
    fair = F.forall(F.map_values(p), lambda v: v.isNotNull() & (v >= 0))
    mass = F.aggregate(F.map_values(p), F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(named & fair & (F.abs(mass - 1) <= tolerance), F.lit(False))


def activation_distance(side: Column, trigger: Column, price: Column, entry: Column, sigma: Column) -> Column:
    """status and z of the way to a resting entry, in horizon deviations; a trigger that is met already is refused."""
    met = F.when(trigger == "price_lte", price <= entry).when(trigger == "price_gte", price >= entry)
    status = F.when(~((price > 0) & (entry > 0) & (sigma > 0)), "invalid_input").when(trigger.isNull(), "active_at_analysis").when(met, "pending_trigger_already_satisfied").otherwise("waiting_for_trigger")
    z = F.when(status == "active_at_analysis", 0.0).when(status == "waiting_for_trigger", F.abs(F.ln(entry / price)) / sigma)
    return F.struct(status.alias("status"), z.alias("z"))


def nearest_period(periods: dict[str, int], horizon_s: Column) -> Column:
    """The name of the period whose length has the least ratio to a horizon; of two alike the longer."""
    far = [F.struct(F.round(F.abs(F.ln(horizon_s / seconds)), 12).alias("d"), F.lit(-seconds).alias("s"), F.lit(name).alias("name")) for name, seconds in periods.items()]
    return F.array_min(F.array(*far))["name"]
