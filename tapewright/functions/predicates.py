"""What is wrong with a plan, and how recorded results agree with evidence, as column expressions; null says that nothing is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an observation after a manual close expects of the path after it.
EXPECTED = {
    "manual_protected": "stop_loss",
    "manual_worse_than_plan": "stop_loss",
    "manual_left_profit": "take_profit",
    "manual_better_than_plan": "take_profit",
    "plan_unresolved": "no_plan_touch",
}
BARRIERS = ("stop_loss", "take_profit")


def first_problem(*checks: tuple[Column, str]) -> Column:
    """The name of the first check that fails; a null answer fails."""
    out = F
    for good, name in checks:
        out = out.when(~F.coalesce(good, F.lit(False)), name)
    return out.otherwise(F.lit(None).cast("string"))


def positive(x: Column) -> Column:
    return (x > 0) & (x < float("inf"))


def limit_plan_problem(side: Column, price: Column, entry: Column, stop: Column, target: Column, trigger: Column) -> Column:
    """Why a resting order is refused: it has to wait for a better price than the market's, between its stop and target."""
    sign = F.when(side == "long", 1).when(side == "short", -1)
    return first_problem(
        (sign.isNotNull(), "invalid_side"),
        (positive(price) & positive(entry) & positive(stop) & positive(target), "invalid_price"),
        (trigger == F.when(sign == 1, "price_lte").otherwise("price_gte"), "limit_v1_supports_pullback_orders_only"),
        (sign * (price - entry) > 0, "limit_trigger_already_satisfied"),
        ((sign * (entry - stop) > 0) & (sign * (target - entry) > 0), "invalid_barrier_geometry"),
    )


def limit_distance(side: Column, price: Column, entry: Column) -> Column:
    """Logarithmic way from the market to a resting entry; null where the entry does not wait."""
    way = F.when(side == "long", F.ln(price / entry)).when(side == "short", F.ln(entry / price))
    return F.when(way > 0, way)


def missing_fields(fields: dict[str, Column]) -> Column:
    """The names of fields that are null or empty text."""
    return F.array_compact(F.array(*[F.when(c.isNull() | (c.cast("string") == ""), n) for n, c in fields.items()]))


def recommendation_problem(own: dict[str, Column], other: dict[str, Column]) -> Column:
    """The first field in which an operation differs from its recommendation; nulls are equal."""
    return first_problem(*[(own[n].eqNullSafe(other[n]), f"{n}_differs") for n in own])


def consistency(reason: Column, observation: Column, touch: Column, later: Column) -> Column:
    """Whether a recorded close agrees with the evidence.

    touch and later (after the close) say stop_loss, take_profit, no_plan_touch or ambiguous...; later is null where it was not looked for.
    """
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])[observation]
    agrees = lambda same: F.when(same, "consistent").otherwise("mismatch")
    after = F.when(expected.isNull() | later.isNull(), "not_comparable").when(later.startswith("ambiguous"), "ambiguous").otherwise(agrees(later == expected))
    return F.when(touch.startswith("ambiguous"), "ambiguous").when(reason.isin(*BARRIERS), agrees(F.coalesce(touch == reason, F.lit(False)))).otherwise(after)


def reconstructed_result(reason: Column, touch: Column, later: Column) -> Column:
    """A plan's result by the evidence: as it went where a barrier closed it, else as it would have gone."""

    def said(by: Column, won: str, lost: str) -> Column:
        return F.when(by == "take_profit", won).when(by == "stop_loss", lost).when(by.startswith("ambiguous"), "ambiguous_same_candle").otherwise("plan_unresolved")

    manual = F.when(later.isNull(), "manual_pending_or_unclassified").otherwise(said(later, "plan_would_succeed", "plan_would_fail"))
    return F.when(reason == "contest_expired", "contest_expiry_mark_to_market").when(reason.isin(*BARRIERS), said(touch, "plan_success", "plan_failure")).otherwise(manual)


def normalised(parts: list[Column]) -> Column:
    """Parts over their sum as an array; null where one is missing or negative, or the sum is 0."""
    total = sum(parts[1:], parts[0])
    fair = total > 0
    for p in parts:
        fair = fair & (p >= 0)
    return F.when(fair, F.array(*[p / total for p in parts]))


def keys_in_json(raw: Column, names: tuple[str, ...]) -> Column:
    """Which of some names are keys anywhere in a JSON text, sorted."""
    found = F.array_distinct(F.regexp_extract_all(raw, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), F.lit(1)))
    return F.array_sort(F.array_intersect(found, F.array(*map(F.lit, names))))


def period_of(ms: Column, ends: dict[str, int]) -> Column:
    """The first period whose end a time does not pass; null behind the last."""
    out = F
    for name, end in ends.items():
        out = out.when(ms <= end, name)
    return out.otherwise(F.lit(None).cast("string"))
