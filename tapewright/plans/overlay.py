"""Bounded effects of rules on given probabilities: signals of evaluated traces, an ordered fold of their effects, and what each of them alone is worth.

Directional evidence moves target against stop and leaves the chance that neither is touched; movement evidence moves both against
that chance and leaves their ratio. Rules act in a fixed order on what the ones before them left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rules in order with their weights, and the shares of them that count at each horizon.
WEIGHTS = {"path_structure": 0.12, "regime": 0.08, "imbalance": 0.12, "interest": 0.06, "price_interest": 0.10, "basis": 0.06, "premium": 0.06, "funding": 0.08}
SHARES = {
    "intraday_short": {"path_structure": 1.0, "regime": 1.0, "imbalance": 1.0, "interest": 0.85, "price_interest": 0.85, "basis": 0.85, "premium": 0.85, "funding": 0.35},
    "intraday_wide": {"path_structure": 1.0, "regime": 1.0, "imbalance": 0.55, "interest": 1.0, "price_interest": 1.0, "basis": 1.0, "premium": 1.0, "funding": 0.75},
    "short_swing": {"path_structure": 1.0, "regime": 1.0, "imbalance": 0.20, "interest": 1.10, "price_interest": 1.10, "basis": 1.10, "premium": 1.10, "funding": 1.25},
}
MOVEMENT = ("interest",)
#: How steep signals of small measures are.
STEEP_INTEREST, STEEP_BASIS, STEEP_PREMIUM, FUNDING_SCALE = 50.0, 100.0, 200.0, 0.0005


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def signals(long: Column, measures: dict[str, Column]) -> dict[str, Column]:
    """The signal of each rule in [-1, 1], as a plan of that side sees it.

    measures: efficiency, volatility_rank, imbalance, interest (change), displacement, basis, premium, funding (rate).
    """
    d = F.when(long, 1.0).otherwise(-1.0)
    m = measures
    return {
        "path_structure": bounded(d * m["efficiency"]),
        "regime": bounded(d * m["efficiency"] * (2 * m["volatility_rank"] - 1)),
        "imbalance": bounded(d * m["imbalance"]),
        "interest": F.tanh(STEEP_INTEREST * F.abs(m["interest"])),
        "price_interest": bounded(d * F.signum(m["displacement"]) * F.tanh(STEEP_INTEREST * m["interest"])),
        "basis": -d * F.tanh(STEEP_BASIS * m["basis"]),
        "premium": -d * F.tanh(STEEP_PREMIUM * m["premium"]),
        "funding": -d * F.tanh(m["funding"] / FUNDING_SCALE),
    }


def active_rules(horizon: Column, statuses: dict[str, Column], found: dict[str, Column]) -> Column:
    """An array of struct(rule, movement, effect) of the evaluated rules in order; null for an unknown horizon."""
    rules = []
    for name, weight in WEIGHTS.items():
        share = F.coalesce(*[F.when(horizon == h, F.lit(s[name])) for h, s in SHARES.items()])
        rule = F.struct(F.lit(name).alias("rule"), F.lit(name in MOVEMENT).alias("movement"), (weight * share * found[name]).alias("effect"))
        rules.append(F.when(statuses[name] == "evaluated", rule))
    return F.when(horizon.isin(*SHARES), F.filter(F.array(*rules), lambda r: r.isNotNull()))


def moved(p: Column, rule: Column) -> Column:
    """struct(tp, sl, none) after one rule."""
    resolved = p["tp"] + p["sl"]
    lift, fall = F.exp(rule["effect"]), F.exp(-rule["effect"])
    after = resolved * lift / (resolved * lift + p["none"] * fall)
    tp = p["tp"] * lift / (p["tp"] * lift + p["sl"] * fall)
    by_movement = F.struct((after * p["tp"] / resolved).alias("tp"), (after * (1 - p["tp"] / resolved)).alias("sl"), (1 - after).alias("none"))
    by_direction = F.struct((resolved * tp).alias("tp"), (resolved * (1 - tp)).alias("sl"), p["none"].alias("none"))
    return F.when(rule["movement"], by_movement).otherwise(by_direction)


def folded(p: Column, rules: Column) -> Column:
    """p after all rules in order; null unless all of p is above 0."""
    return F.when((p["tp"] > 0) & (p["sl"] > 0) & (p["none"] > 0), F.aggregate(rules, p, moved))


def contributions(p: Column, rules: Column, after: Column) -> Column:
    """An array of struct(rule, tp, sl, none): what each rule changes in the end, against the fold without it."""

    def one(rule: Column) -> Column:
        without = folded(p, F.filter(rules, lambda r: r["rule"] != rule["rule"]))
        return F.struct(rule["rule"].alias("rule"), *[(after[n] - without[n]).alias(n) for n in ("tp", "sl", "none")])

    return F.transform(rules, one)
