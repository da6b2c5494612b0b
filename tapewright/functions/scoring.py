"""Scores of a plan as column expressions.

A side is a sign: 1 for long, -1 for short. Most scores are a vote of one measure (1, 0 or -1 by two limits, 0 where it is null)
turned to the plan's side, so a vote for the plan earns points and a vote against it, or a crowd already on its side, costs them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of each horizon the weights of timeframes, the one that confirms, and how much weight it and the regime have.
HORIZONS = {
    "intraday_short": {"weights": {"5m": 1.25, "15m": 1.35, "1h": 1.0, "4h": 0.45, "1d": 0.15}, "confirmation": "1h", "higher": 0.6, "regime": 0.85},
    "intraday_wide": {"weights": {"5m": 0.35, "15m": 1.1, "1h": 1.35, "4h": 1.0, "1d": 0.35}, "confirmation": "4h", "higher": 1.0, "regime": 1.0},
    "short_swing": {"weights": {"5m": 0.1, "15m": 0.2, "1h": 0.75, "4h": 1.5, "1d": 1.6}, "confirmation": "1w", "higher": 1.35, "regime": 1.15},
}
#: Zones of a retracement, by their upper ends (those from golden_zone on hold theirs).
ZONES = (
    (-0.03, "extension"),
    (0.236, "ruptura_o_retroceso_muy_superficial"),
    (0.382, "retroceso_superficial"),
    (0.618, "golden_zone"),
    (0.786, "retroceso_profundo"),
    (1.0, "retroceso_extremo"),
)
#: Names of regimes.
COMPRESSION, BULLISH, BEARISH, REBOUND, MIXED = "compresion", "tendencia_alcista", "tendencia_bajista", "rebote_contra_tendencia", "mixto"


def sign_of(side: Column) -> Column:
    return F.when(side == "long", 1).when(side == "short", -1)


def vote(x: Column, high: float, low: float, closed: bool = False) -> Column:
    """1 above high, -1 below low, else 0; closed limits count as above and below."""
    up, down = (x >= high, x <= low) if closed else (x > high, x < low)
    return F.when(up, 1).when(down, -1).otherwise(0)


def stack_vote(stack: Column) -> Column:
    return F.when(stack == "bullish", 1).when(stack == "bearish", -1).otherwise(0)


def ladder(x: Column, steps: list[tuple[float, object]], other: object) -> Column:
    """The value of the first step that x reaches."""
    out = F
    for least, value in steps:
        out = out.when(x >= least, value)
    return out.otherwise(other)


def both_ways(x: Column, steps: list[tuple[float, object, object]], other: object) -> Column:
    """Like ladder, with a value for x at or above a limit and one for x at or below its negative."""
    out = F
    for limit, above, below in steps:
        out = out.when(x >= limit, above).when(x <= -limit, below)
    return out.otherwise(other)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def percent_of(a: Column, b: Column) -> Column:
    """The distance of a from b in percent of b; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(F.abs((a - b) / b) * 100)


def to_percent(x: Column, low: Column | float, high: Column | float) -> Column:
    """x between low and high as 0 to 100, rounded half to even; 50 where they are equal."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(high == low, 50.0).otherwise(F.bround(clamp((x - low) / (high - low), 0.0, 1.0) * 100))


def horizon_value(horizon: Column, key: str) -> Column:
    """A horizon's value; unknown horizons are the shortest."""
    out = F
    for name, values in HORIZONS.items():
        out = out.when(horizon == name, values[key])
    return out.otherwise(HORIZONS["intraday_short"][key])


# ---- single measures


def flow_score(sign: Column, ratio: Column) -> Column:
    return sign * vote(F.when(ratio != 0, ratio), 1.12, 0.88) * 0.02


def cvd_score(sign: Column, ratio: Column) -> Column:
    return sign * vote(ratio, 0.12, -0.12) * 0.018


def breadth_score(sign: Column, advancers: Column, median: Column) -> Column:
    return sign * F.when((advancers >= 58) & (median > 0), 1).when((advancers <= 42) & (median < 0), -1).otherwise(0) * 0.02


def interest_score(sign: Column, change: Column, interest: Column) -> Column:
    """Growing open interest backs the direction of the price."""
    return sign * F.when(interest >= 0.2, F.signum(change)).otherwise(0) * 0.02


def crowded(sign: Column, voted: Column, cost: float) -> Column:
    """The cost where the vote is already on the plan's side."""
    return F.when(sign * voted == 1, cost).otherwise(0.0)


def funding_penalty(sign: Column, rate: Column) -> Column:
    return crowded(sign, vote(rate, 0.03, -0.03), 0.025)


def funding_relative_penalty(sign: Column, rate: Column, recent: Column) -> Column:
    far = (F.abs(recent) >= 1e-6) & (F.abs(rate) / F.abs(recent) >= 1.8)
    return crowded(sign, F.when(far, F.signum(rate)).otherwise(0), 0.01)


def crowding_penalty(sign: Column, ratio: Column) -> Column:
    return crowded(sign, vote(F.when(ratio != 0, ratio), 2.0, 0.5), 0.015)


def sentiment_penalty(sign: Column, greed: Column) -> Column:
    return crowded(sign, vote(greed, 75, 25, closed=True), 0.015)


def interest_price_penalty(sign: Column, change: Column, interest: Column) -> Column:
    return crowded(sign, F.when(interest < -0.2, vote(change, 0.5, -0.5)).otherwise(0), 0.012)


def level_penalty(barrier_pct: Column, reward_pct: Column) -> Column:
    """The cost of a barrier that lies within a third of the way, or very near."""
    return F.when(barrier_pct < F.greatest(F.lit(0.25), reward_pct * 0.35), 0.025).otherwise(0.0)


def higher_penalty(sign: Column, stacks: Column, horizon: Column) -> Column:
    """The cost of a confirming timeframe that runs against the plan; where it is missing the 4h one is asked."""
    asked = F.coalesce(stacks[horizon_value(horizon, "confirmation")], stacks["4h"])
    return F.when(sign * stack_vote(asked) == -1, horizon_value(horizon, "higher") * 0.018).otherwise(0.0)


def contradiction_penalty(cvd: Column, flow: Column, *costs: Column) -> Column:
    """Steps by the number of contradictions: flows of opposite signs, and every other cost that is not 0."""
    n = (cvd * flow < 0).cast("int")
    for c in costs:
        n = n + (c != 0).cast("int")
    return ladder(n, [(4, 0.045), (3, 0.032), (2, 0.018)], 0.0)


# ---- timeframes


def weighted(values: dict[str, Column], horizon: Column) -> Column:
    """The mean of the timeframes' values by the horizon's weights; missing timeframes have none."""

    def mean(weights: dict[str, float]) -> Column:
        parts = [(F.coalesce(v * weights[k], F.lit(0.0)), F.when(v.isNotNull(), weights[k]).otherwise(0.0)) for k, v in values.items()]
        mass = sum((w for _, w in parts[1:]), parts[0][1])
        return F.when(mass > 0, sum((v for v, _ in parts[1:]), parts[0][0]) / mass).otherwise(0.0)

    out = F
    for name, h in HORIZONS.items():
        out = out.when(horizon == name, mean(h["weights"]))
    return out.otherwise(mean(HORIZONS["intraday_short"]["weights"]))


def trend_score(sign: Column, stacks: Column, horizon: Column) -> Column:
    votes = {k: F.when(stacks[k].isNotNull(), stack_vote(stacks[k])) for k in HORIZONS["intraday_short"]["weights"]}
    return both_ways(sign * weighted(votes, horizon), [(0.55, 0.1, -0.09), (0.2, 0.05, -0.05)], 0.0)


def timeframe_score(sign: Column, stack: Column, from_ema: Column, rsi: Column) -> Column:
    """Stack, place against the average, and RSI of one timeframe, between -1 and 1."""
    near = F.coalesce(from_ema, F.lit(0.0))
    strength = F.coalesce(rsi, F.lit(50.0))
    by_rsi = F.when(strength.between(45, 65), 0.2).when(strength > 75, -0.25).when(strength < 25, 0.1).when((strength >= 35) & (strength < 45), 0.05).otherwise(0.0)
    return clamp(sign * (stack_vote(stack) * 0.55 + vote(near, 0.08, -0.08) * 0.25 + by_rsi), -1.0, 1.0)


def technical_rating(sign: Column, mean: Column, rsi: Column, from_ema: Column, atr_pct: Column, barrier_pct: Column, reward_pct: Column) -> Column:
    """score, direction_bias, entry_timing_penalty, barrier_penalty, confidence_adjustment and label of a mean timeframe score."""
    late = (sign * vote(F.coalesce(rsi, F.lit(50.0)), 72, 28, closed=True) == 1) & (sign * F.coalesce(from_ema, F.lit(0.0)) > F.greatest(F.lit(0.45), atr_pct * 1.7))
    timing = F.when(late, 0.02).otherwise(0.0)
    share = F.when(reward_pct > 0, barrier_pct / reward_pct)
    barrier = F.when(share < 0.55, 0.025).when(share < 0.85, 0.012).otherwise(0.0)
    score = F.bround(clamp(mean * 50 + 50, 0.0, 100.0))
    moved = both_ways(mean, [(0.45, 6, -8), (0.15, 3, -4)], 0) - F.when(timing > 0, 4).otherwise(0) - F.when(barrier > 0, 4).otherwise(0)
    return F.struct(
        score.alias("score"),
        both_ways(mean, [(0.45, 0.035, -0.04), (0.15, 0.015, -0.02)], 0.0).alias("direction_bias"),
        timing.alias("entry_timing_penalty"),
        barrier.alias("barrier_penalty"),
        moved.alias("confidence_adjustment"),
        F.when(score >= 60, "favorable").when(score <= 40, "desfavorable").otherwise("neutral").alias("label"),
    )


def market_regime(sign: Column, stacks: Column, range_pct: Column, atr_pct: Column) -> Column:
    """Narrow and quiet markets first, then three stacks of one kind, then a 4h stack against the plan."""
    count = lambda kind: F.size(F.filter(F.map_values(stacks), lambda v: v == kind))
    against = F.coalesce(sign * stack_vote(stacks["4h"]) == -1, F.lit(False))
    return F.when((range_pct < 0.45) & (atr_pct < 0.08), COMPRESSION).when(count("bullish") >= 3, BULLISH).when(count("bearish") >= 3, BEARISH).when(against, REBOUND).otherwise(MIXED)


def regime_bias(sign: Column, regime: Column, horizon: Column) -> Column:
    along = sign * F.when(regime == BULLISH, 1).when(regime == BEARISH, -1).otherwise(0)
    trend = F.when(along == 1, 0.024).when(along == -1, -0.028).otherwise(0.0) * horizon_value(horizon, "regime")
    return F.when(regime == REBOUND, horizon_value(horizon, "higher") * -0.018).otherwise(trend)


def range_probability(range_pct: Column, contradiction: Column, regime: Column) -> Column:
    return F.when(regime.isin(COMPRESSION, MIXED), 0.12).when(contradiction >= 0.03, 0.1).when(range_pct < 1.2, 0.08).otherwise(0.06)


def probability_band(p: Column, width: Column) -> Column:
    low, high = F.greatest(F.lit(0.01), p - width / 2), F.least(F.lit(0.99), p + width / 2)
    text = lambda x: F.concat(F.bround(x * 100).cast("int").cast("string"), F.lit("%"))
    return F.struct(F.bround(low, 4).alias("low"), F.bround(high, 4).alias("high"), F.concat_ws("-", text(low), text(high)).alias("label"))


def probability_bands(target: Column, stop: Column, middle: Column, contradiction: Column) -> Column:
    """Bands of the three probabilities, wider with contradictions; that of the range at most 0.05 wide."""
    width = F.when(contradiction == 0, 0.04).when(contradiction < 0.03, 0.06).otherwise(0.08)
    return F.struct(probability_band(target, width).alias("tp"), probability_band(stop, width).alias("sl"), probability_band(middle, F.least(width, F.lit(0.05))).alias("range"))


# ---- money and grades


def expected_value(margin: Column, leverage: Column, target: Column, stop: Column, middle: Column, reward_pct: Column, risk_pct: Column, spread_pct: Column, funding_pct: Column) -> Column:
    """Notional, costs, net results and expected value of a plan, after round-trip fees, slippage and funding."""
    notional = margin * leverage
    cost = notional * (F.greatest(spread_pct / 100, F.lit(0.0002)) + 0.0008) + notional * F.abs(F.coalesce(funding_pct, F.lit(0.0))) / 100
    win, loss = notional * reward_pct / 100 - cost, notional * risk_pct / 100 + cost
    value = target * win - stop * loss - middle * cost
    share = lambda of: F.when(of != 0, F.bround(value / of * 100, 4)).otherwise(0.0)
    return F.struct(
        notional.alias("notional"),
        F.bround(cost, 4).alias("cost"),
        F.bround(win, 4).alias("net_win"),
        F.bround(loss, 4).alias("net_loss"),
        F.bround(value, 4).alias("value"),
        share(margin).alias("of_margin"),
        share(notional).alias("of_notional"),
        F.when(value > 0, "positiva").when(value < 0, "negativa").otherwise("neutral").alias("label"),
    )


# The weights, start values and limits of the three scores; sums run in this order, as doubles round by it.


def quality_score(reward_risk: Column, of_notional: Column, fibonacci: Column, price_risk_pct: Column, cut: Column) -> Column:
    raw = 42 + to_percent(reward_risk, 0.8, 3.2) * 0.16 + to_percent(of_notional, -0.8, 1.2) * 0.22 + (fibonacci - 50) * 0.12 - F.least(F.lit(22.0), price_risk_pct * 4.5)
    return F.greatest(F.lit(0.0), F.bround(clamp(raw, 0.0, 100.0)) - cut)


def execution_risk(volatility: Column, level: Column, fibonacci: Column, liquidity: Column, added: Column, spread_pct: Column) -> Column:
    return F.bround(clamp(30 + volatility * 220 + level * 300 + fibonacci + liquidity * 250 + added + to_percent(spread_pct, 0, 0.08) * 0.35, 0.0, 100.0))


def confidence_score(contradiction: Column, higher: Column, bias: Column, flow: Column, cvd: Column, adjustment: Column, cut: Column) -> Column:
    aligned = 70 - F.bround(contradiction * 700) - F.when(higher != 0, 12).otherwise(0) + F.bround(bias * 420) - F.when(flow * cvd < 0, 12).otherwise(0)
    return clamp(aligned + F.bround(adjustment.cast("double")) - cut, 15.0, 95.0)


def grade(target: Column, risk: Column, value_score: Column) -> Column:
    best = (target >= 0.62) & (risk < 0.2) & (value_score >= 58)
    good = (target >= 0.52) & (risk < 0.36) & (value_score >= 50)
    return F.when(best, "A").when(good, "B").when((target >= 0.44) & (value_score >= 42), "C").otherwise("D")


def capped(grade_: Column, cap: Column) -> Column:
    """The worse of a grade and its cap."""
    return F.greatest(grade_, cap)


def confidence(score: Column) -> Column:
    return ladder(score, [(76, "alta"), (61, "media"), (46, "media-baja")], "baja")


def decision(grade_: Column, risk_level: Column, confidence_: Column, value: Column, forced: Column) -> Column:
    stay = F.coalesce(forced, F.lit(False)) | (value < 0) | (risk_level == "alto")
    firm = grade_.isin("A", "B") & confidence_.isin("alta", "media")
    return F.when(stay, "observar").when(firm, "simular").when(grade_.isin("B", "C"), "simular con tamano prudente").otherwise("observar")


def path_quality(sign: Column, entry: Column, target: Column, barrier: Column, reward_pct: Column, atr_pct: Column) -> Column:
    """How free the way to the target is: worst with the barrier on it, best with the barrier at the target."""
    between = (sign * (barrier - entry) > 0) & (sign * (target - barrier) > 0)
    on_way = F.bround(clamp(to_percent(percent_of(barrier, entry), F.lit(0.0), reward_pct) * 0.25 + 35, 15.0, 55.0))
    near = F.abs(target - barrier) / F.greatest(F.abs(barrier), F.lit(1e-6)) * 100 <= F.greatest(F.lit(0.12), atr_pct * 0.45)
    return F.when(reward_pct <= 0, 0.0).when(barrier.isNull(), 60.0).when(between, on_way).when(near, 70.0).otherwise(62.0)


def fibonacci_zone(price: Column, up: Column, start: Column, end: Column) -> Column:
    """The zone of a price's retracement from the end of a swing."""
    back = F.when(up, end - price).otherwise(price - end) / F.abs(end - start)
    out = F.when(start == end, "sin_rango")
    for i, (limit, name) in enumerate(ZONES):
        out = out.when(back <= limit if i > 2 else back < limit, name)
    return out.otherwise("estructura_rota")


def ema_stack(fast: Column, middle: Column, slow: Column) -> Column:
    return F.when((fast > middle) & (middle > slow), "bullish").when((fast < middle) & (middle < slow), "bearish").otherwise("mixed")


# ---- reads of results

#: What an observation after a manual close says of the plan.
OBSERVED = {
    "manual_protected": "plan_would_fail",
    "manual_left_profit": "plan_would_succeed",
    "manual_better_than_plan": "plan_would_succeed",
    "plan_unresolved": "plan_unresolved",
}
#: What it says of the user's decision.
DECIDED = {
    "manual_protected": "protected_capital",
    "manual_left_profit": "premature_or_worse_exit",
    "manual_worse_than_plan": "premature_or_worse_exit",
    "manual_better_than_plan": "better_than_plan",
}
#: Reasons of closes that are the user's.
MANUAL = ("manual", "cut_loss", "take_partial", "emotion", "invalidated")


def named(value: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]


def plan_result(reason: Column, observation: Column) -> Column:
    barrier = F.when(reason == "take_profit", "plan_success").when(reason == "stop_loss", "plan_failure")
    return F.coalesce(barrier, named(observation, OBSERVED), F.when(reason == "contest_expired", "contest_expiry_mark_to_market"), F.lit("manual_pending_or_unclassified"))


def decision_quality(reason: Column, observation: Column, trigger: Column) -> Column:
    later = F.when(trigger.isNull(), "inconclusive").otherwise("pending_classification")
    return F.when(reason.isin(*MANUAL), F.coalesce(named(observation, DECIDED), later))


def verdict(result: Column, target: Column, stop: Column, warned: Column, grade_: Column, quality: Column) -> Column:
    """What a result says of the analysis, given whether that had warned."""
    tp, sl = F.coalesce(target, F.lit(0.0)), F.coalesce(stop, F.lit(0.0))
    backed = ~warned & ((tp >= sl) | F.coalesce(grade_.isin("A", "B", "C"), F.lit(False)))
    lost = F.when(warned & F.coalesce(quality == "risk_underweighted", F.lit(False)), "analysis_warned_but_underweighted_risk").when(warned | (sl >= tp), "analysis_warned_risk").otherwise("analysis_missed_risk")
    won = F.when(backed, "analysis_supported_success").otherwise("success_against_analysis")
    return F.when(result.isin("plan_success", "plan_would_succeed"), won).when(result.isin("plan_failure", "plan_would_fail"), lost).otherwise("analysis_unresolved")


def warned(target: Column, stop: Column, grade_: Column, confidence_: Column, decision_: Column, value: Column, fibonacci: Column, zone_delta: Column, zone_risk: Column, sweep: Column) -> Column:
    """Whether an analysis advised against its plan in any way."""
    signs = (
        grade_.isin("D", "E"),
        confidence_.isin("baja", "media-baja"),
        F.lower(decision_) == "observar",
        F.coalesce(target, F.lit(0.0)) < F.coalesce(stop, F.lit(0.0)),
        value < 0,
        F.lower(fibonacci).isin("alerta", "desfavorable"),
        zone_delta < 0,
        zone_risk >= 0.02,
        F.lower(sweep) == "alto",
    )
    return F.exists(F.array(*[F.coalesce(s, F.lit(False)) for s in signs]), lambda x: x)


def learning_read(cases: Column, wins: Column, losses: Column) -> Column:
    few = (wins < 10) | (losses < 10)
    return F.when(cases < 10, "early_observation").when(cases < 30, "signal_to_monitor").when((cases < 50) | few, "candidate_for_formal_review").otherwise("eligible_for_validation")


def pattern_read(wins: Column, losses: Column, mean_r: Column) -> Column:
    """Risk or winner pattern; a mean result that says otherwise than the counts leaves it mixed."""
    risk = F.when(mean_r.isNull(), losses > wins).otherwise((losses > wins) & (mean_r < 0))
    winner = F.when(mean_r.isNull(), wins > losses).otherwise((wins >= losses) & (mean_r >= 0))
    return F.when(risk, "observed_risk_pattern").when(winner, "observed_winner_pattern").otherwise("mixed_context_needs_review")


def signed_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "sin_dato").when(x > 0.003, "positivo").when(x < -0.003, "negativo").otherwise("neutral")


def score_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "sin_dato").otherwise(ladder(x, [(65, "fuerte"), (55, "favorable"), (45, "neutral"), (35, "bajo")], "muy_bajo"))


def value_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "sin_dato").when(x < 0, "negativa").when(x > 0, "positiva").otherwise("neutral")


def leverage_bucket(x: Column) -> Column:
    return ladder(x, [(8, "alto"), (4, "medio")], "bajo")
