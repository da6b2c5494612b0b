"""Rules on market context and on a plan's money, as traces like those of rules.py.

A rule's guards are asked in order, and the first that fails gives the reason; a null answer fails. A guard may defer instead of
block: what it needs will be known later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Roles of an order, and the parts that have to be known before a plan is judged.
ROLES = ("maker", "rpi", "taker")
READY_PARTS = ("market_probabilities", "entry_execution", "exit_execution", "fees", "funding", "payoffs", "account_risk")
READY_STATES = ("available", "not_applicable", "blocked")
MAX_AGE_MS = 30_000


# The reasons in this module's guards, with their statuses.


def ruled(outputs: dict[str, Column], guards: list[tuple], parents: list[Column] = ()) -> Column:
    """A trace: status, reason and outputs; guards are (condition, reason) or (condition, reason, status)."""
    checks = [*((p["status"] == "evaluated", "dependency_not_evaluated", "blocked") for p in parents), *((*g, "blocked")[:3] for g in guards)]
    numbers = [c for n, c in outputs.items() if not n.endswith("_") and not n.startswith("is_")]
    finite = F.lit(True)
    for c in numbers:
        finite = finite & (F.abs(c.cast("double")) < float("inf"))
    checks.append((finite, "output_not_finite", "blocked"))
    status = reason = F
    for good, why, state in checks:
        failed = ~F.coalesce(good, F.lit(False))
        status, reason = status.when(failed, state), reason.when(failed, why)
    status = status.otherwise("evaluated")
    named = [F.when(status == "evaluated", c).alias(n.strip("_")) for n, c in outputs.items()]
    return F.struct(status.alias("status"), reason.otherwise(F.lit(None).cast("string")).alias("reason"), *named)


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


# ---- derivatives


def aggressor_imbalance(buy: Column, sell: Column, start: Column, end: Column, seen_from: Column, seen_to: Column) -> Column:
    """Taker buying less taker selling over all activity, of a window that is wholly covered."""
    total = buy + sell
    guards = [((buy >= 0) & (sell >= 0), "invalid_activity"), (total > 0, "zero_activity"), ((end > start) & (seen_from <= start) & (seen_to >= end), "incomplete_window_coverage")]
    return ruled({"imbalance": (buy - sell) / total, "total": total}, guards)


def compared_imbalances(by_trades: Column, by_periods: Column) -> Column:
    """Two sources of one imbalance side by side; they are never combined."""
    alike = F.when((by_trades == 0) | (by_periods == 0), "flat").when(sign(by_trades) == sign(by_periods), "same").otherwise("opposite")
    return F.struct((by_trades - by_periods).alias("difference"), alike.alias("signs"))


def open_interest_change(before: Column, now: Column, before_ms: Column, now_ms: Column, horizon_ms: int) -> Column:
    guards = [(now_ms - before_ms == horizon_ms, "open_interest_alignment_error"), ((before > 0) & (now > 0), "invalid_open_interest")]
    change = F.ln(now / before)
    return ruled({"change": change, "direction": sign(change)}, guards)


def price_interest_state(displacement: Column, interest: Column) -> Column:
    """Signs of a price's and of the open interest's change; interest is a trace."""
    text = F.concat(F.lit("price_"), sign(displacement).cast("string"), F.lit("_oi_"), sign(interest["change"]).cast("string"))
    return ruled({"displacement": displacement, "interest": interest["change"], "state_": text}, [], [interest])


def spot_basis(bid: Column, ask: Column, spot_bid: Column, spot_ask: Column, skew_ms: Column, limit_ms: int | None) -> Column:
    """Logarithmic basis of mid prices, and the bounds that can be traded."""
    guards = [((bid > 0) & (spot_bid > 0), "invalid_quote"), ((ask >= bid) & (spot_ask >= spot_bid), "crossed_book")]
    if limit_ms is not None:
        guards.append((F.abs(skew_ms) <= limit_ms, "basis_capture_skew_exceeded"))
    return ruled({"basis": F.ln((bid + ask) / (spot_bid + spot_ask)), "sell_side": F.ln(bid / spot_ask), "buy_side": F.ln(ask / spot_bid)}, guards)


def mark_premium(mark: Column, index: Column) -> Column:
    return ruled({"premium": F.ln(mark / index)}, [((mark > 0) & (index > 0), "invalid_price")])


def funding_state(rate: Column, interval_hours: Column, load: Column, scheduled: Column, next_ms: Column, horizon_hours: float) -> Column:
    """The hourly rate, and the load of the events of the horizon behind; a future rate is not assumed."""
    guards = [(interval_hours > 0, "invalid_interval"), (next_ms.isNull() | (next_ms > 0), "invalid_timestamp")]
    return ruled({"per_hour": rate / interval_hours, "load": load, "load_per_hour": load / horizon_hours, "scheduled": scheduled, "next_ms_": next_ms}, guards)


def derivatives_context(imbalance: Column, interest: Column, funding: Column, source: Column, spot: Column, mark: Column) -> Column:
    """The four measures together; source says which basis is meant, and only that one has to be evaluated."""
    chosen = F.when(source == "spot_futures", spot["status"]).when(source == "mark_index", mark["status"])
    basis = F.when(source == "spot_futures", spot["basis"]).otherwise(mark["premium"])
    outputs = {"imbalance": imbalance["imbalance"], "interest": interest["change"], "basis": basis, "funding_per_hour": funding["per_hour"]}
    return ruled(outputs, [(source.isin("spot_futures", "mark_index"), "invalid_source"), (chosen == "evaluated", "dependency_not_evaluated")], [imbalance, interest, funding])


def quoted_spread(bid: Column, ask: Column, received_ms: Column, captured_ms: Column, max_age_ms: int = MAX_AGE_MS) -> Column:
    age = captured_ms - received_ms
    guards = [((bid > 0) & (ask > 0), "invalid_quote"), (ask >= bid, "crossed_book"), (age >= 0, "book_received_after_capture"), (age <= max_age_ms, "stale_quoted_book")]
    mid = (bid + ask) / 2
    return ruled({"mid": mid, "spread": ask - bid, "fraction": (ask - bid) / mid, "age_ms": age}, guards)


# ---- money


def plan_exposure(side: Column, entry: Column, target: Column, stop: Column, margin: Column, leverage: Column) -> Column:
    way = F.when(side == "long", 1).when(side == "short", -1)
    notional = margin * leverage
    quantity = notional / entry
    reward, risk = way * quantity * (target - entry), way * quantity * (entry - stop)
    positive = (entry > 0) & (target > 0) & (stop > 0) & (margin > 0) & (leverage > 0)
    guards = [(way.isNotNull() & positive, "invalid_input"), ((reward > 0) & (risk > 0), "invalid_exposure_geometry")]
    return ruled({"notional": notional, "quantity": quantity, "reward": reward, "risk": risk, "reward_risk": reward / risk, "of_margin": risk / margin}, guards)


def fee_scenarios(notional: Column, rates: Column, roles: Column, observed: Column, asset: Column) -> Column:
    """Fees of each role that may apply, from a map of rates; exact only for an observed execution in one role."""
    distinct = F.array_sort(F.array_distinct(roles))
    known = F.forall(distinct, lambda r: r.isin(*ROLES)) & (F.size(distinct) > 0)
    fees = F.transform(distinct, lambda r: notional * rates[r])
    complete = F.forall(distinct, lambda r: rates[r].isNotNull() & (rates[r] >= 0))
    exact = F.coalesce(observed, F.lit(False)) & (F.size(distinct) == 1) & asset.isNotNull()
    guards = [(notional >= 0, "invalid_notional"), (known, "invalid_liquidity_roles"), (complete, "missing_commission_rate")]
    return ruled({"lower": F.array_min(fees), "upper": F.array_max(fees), "is_exact": exact}, guards)


def funding_cashflow(side: Column, quantity: Column, events: Column, scheduled: Column) -> Column:
    """Sum of the cash flows of funding events (mark, rate); without events it is 0 if none is scheduled, else not known yet."""
    way = F.when(side == "long", 1).when(side == "short", -1)
    total = F.aggregate(events, F.lit(0.0), lambda acc, e: acc - way * quantity * e["mark"] * e["rate"])
    guards = [(way.isNotNull() & (quantity > 0), "invalid_input"), ((F.size(events) > 0) | (scheduled == 0), "future_funding_rate_unknown", "deferred"), (F.forall(events, lambda e: e["mark"] > 0), "invalid_event")]
    return ruled({"total": total, "events": F.size(events)}, guards)


def net_payoffs(gross: Column, fees: Column, shortfall: Column, funding: Column) -> Column:
    """Gross less fees and shortfall plus funding for each outcome; all four are maps with the same keys."""
    keys = F.array_sort(F.map_keys(gross))
    same = (F.size(keys) > 0) & (F.array_sort(F.map_keys(fees)) == keys) & (F.array_sort(F.map_keys(shortfall)) == keys) & (F.array_sort(F.map_keys(funding)) == keys)
    net = F.transform_values(gross, lambda k, v: v - fees[k] - shortfall[k] + funding[k])
    costs = F.forall(F.map_values(fees), lambda v: v >= 0) & F.forall(F.map_values(shortfall), lambda v: v >= 0)
    idle = ~F.map_contains_key(net, "no_entry") | (net["no_entry"] == 0)
    return ruled({"net_": net}, [(same, "payoff_outcome_key_mismatch"), (costs, "invalid_cost"), (idle, "invalid_no_entry_cashflow")])


def expected_value(probabilities: Column, payoffs: Column, authorized: Column) -> Column:
    """Sum of probability times payoff over maps with the same keys; the probabilities have to add up to 1."""
    keys = F.array_sort(F.map_keys(probabilities))
    mass = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, v: a + v)
    value = F.aggregate(keys, F.lit(0.0), lambda a, k: a + probabilities[k] * payoffs[k])
    guards = [
        (authorized, "m6_probabilities_unavailable", "deferred"),
        ((F.size(keys) > 0) & (F.array_sort(F.map_keys(payoffs)) == keys), "expected_value_key_mismatch"),
        (F.forall(F.map_values(probabilities), lambda v: v >= 0), "invalid_probability"),
        (F.abs(mass - 1) <= 1e-9, "probability_mass_not_one"),
    ]
    return ruled({"value": value}, guards)


def readiness(statuses: Column) -> Column:
    """Whether all economic parts of a map of statuses are there, and the account's risk; never a decision."""
    keys = F.array_sort(F.map_keys(statuses))
    fine = F.forall(F.array(*[statuses[p] for p in READY_PARTS if p != "account_risk"]), lambda s: s.isin(*READY_STATES[:2]))
    guards = [(keys == F.array(*map(F.lit, sorted(READY_PARTS))), "readiness_status_key_mismatch"), (F.forall(F.map_values(statuses), lambda s: s.isin(*READY_STATES)), "invalid_readiness_status")]
    return ruled({"is_economic": fine, "is_account": statuses["account_risk"] == "available"}, guards)
