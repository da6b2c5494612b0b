"""Library rules that only observe: technical, positioning, order book, volume, compression, absorption, liquidation and waiting orders.

Each gives a trace as in market_rules. Rules on bars keep every bar; one without enough history behind it is blocked. Recursive
averages start at the first bar of a stated lookback, so frames are bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scoring import sign_of
from tapewright.operators.indicators import back, changes, median_of, midrank, seeded_ema_of, wilder_of
from tapewright.plans.market_rules import ruled

#: Lengths of histories, levels and bands of a book in basis points, and the reasons of blocked rules.
TECHNICAL_BARS = 206
REFERENCE = 60
TOP_LEVELS = (5, 20)
BANDS_BPS = (10, 20, 50)
NO_TECHNICAL = "insufficient_closed_candles_for_ema200_and_slope"
NO_ATR = "zero_atr"
NO_FUNDING = "missing_or_invalid_current_funding_rate"
FEW_FUNDINGS = "insufficient_60_prior_funding_rates"
FEW_CROWDS = "insufficient_current_plus_60_crowding_periods"
GAPPED_CROWDS = "gapped_crowding_history"
FEW_VOLUMES = "insufficient_60_horizon_volume_history"
ZERO_VOLUME = "zero_reference_volume_median"
FEW_ENDPOINTS = "insufficient_61_horizon_endpoints"
ZERO_RANGE = "zero_horizon_price_range"
NO_BOOK = "valid_uncrossed_depth_snapshot_unavailable"
NO_CLUSTERS = "missing_liquidation_context"
BAD_GEOMETRY = "invalid_barrier_geometry"
FEW_CONTEXT = "insufficient_four_horizon_context"
NO_SIGMA = "non_positive_horizon_volatility"
NO_PIVOTS = "no_confirmed_pivots_in_four_horizon_context"
NO_FLOW = "no_flow_or_derivatives_parent_available"


def technical(bars: DataFrame, side: Column) -> DataFrame:
    """EMA trend, Wilder's RSI and the distance from EMA 20 in ATRs at each bar, from its last 206 bars."""
    df = changes(bars).withColumns({"side": side, "_range": F.first(F.col("high") - F.col("low")).over(back(TECHNICAL_BARS))})
    df = df.withColumns({f"_{c}": F.collect_list(c).over(back(TECHNICAL_BARS)) for c in ("close", "change", "true_range")})
    # the lookback's first bar has no close before it; the series' first has no change, which the list leaves out
    moves = F.slice("_change", 1 - TECHNICAL_BARS, TECHNICAL_BARS - 1)
    df = df.select(
        "symbol",
        "open_ms",
        "close",
        "n",
        sign_of(F.col("side")).alias("s"),
        F.when(F.col("n") >= TECHNICAL_BARS, F.struct(F.col("_close").alias("c"), moves.alias("d"), F.concat(F.array("_range"), F.slice("_true_range", 2, TECHNICAL_BARS)).alias("r"))).alias("a"),
    )
    ema = {f"ema{p}": seeded_ema_of(F.col("a.c"), p) for p in (20, 50, 200)}
    before = seeded_ema_of(F.slice("a.c", 1, TECHNICAL_BARS - 6), 50)
    up = wilder_of(F.transform("a.d", lambda x: F.greatest(x, F.lit(0.0))), 14)
    down = wilder_of(F.transform("a.d", lambda x: F.greatest(-x, F.lit(0.0))), 14)
    df = df.withColumns({**ema, "before": before, "up": up, "down": down, "atr": wilder_of(F.col("a.r"), 14)}).drop("a")
    rsi = F.when((F.col("up") == 0) & (F.col("down") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("up") / F.col("down")))
    df = df.withColumns({"rsi": rsi, "slope": (F.col("ema50") - F.col("before")) / F.col("atr"), "extension": (F.col("close") - F.col("ema20")) / F.col("atr"), "near": F.ln(F.col("close") / F.col("ema50")), "far": F.ln(F.col("ema50") / F.col("ema200"))})
    guards, s = [(F.col("n") >= TECHNICAL_BARS, NO_TECHNICAL), (F.col("atr") > 0, NO_ATR)], F.col("s")
    centered = (F.col("rsi") - 50) / 50
    trend = {n: F.col(n) for n in ("ema50", "ema200", "slope", "near", "far")} | {f"side_{n}": s * F.col(n) for n in ("slope", "near", "far")}
    extension = {"ema20": F.col("ema20"), "atr": F.col("atr"), "atr_fraction": F.col("atr") / F.col("close"), "extension": F.col("extension"), "side_extension": s * F.col("extension")}
    df = df.withColumns({"ema_trend": ruled(trend, guards), "rsi_wilder": ruled({"rsi": F.col("rsi"), "centered": centered, "side_centered": s * centered}, guards)})
    df = df.withColumn("atr_extension", ruled(extension, guards, [F.col("ema_trend")]))
    return df.select("symbol", "open_ms", "ema_trend", "rsi_wilder", "atr_extension")


def place(df: DataFrame, value: str, reference: str) -> DataFrame:
    """df with rank, median, mad and robust_z (null without deviation) of a value among a reference array."""
    df = df.withColumn("median", median_of(F.col(reference)))
    df = df.withColumn("mad", median_of(F.transform(reference, lambda x: F.abs(x - F.col("median")))))
    z = F.when(F.col("mad") > 0, (F.col(value) - F.col("median")) / (F.col("mad") * 1.4826))
    return df.withColumns({"rank": midrank(F.col(value), F.col(reference)), "robust_z": z})


def before(count: int, *keys: str) -> Window:
    """The rows strictly before, at most count of them."""
    return Window.partitionBy("symbol", *keys).orderBy("open_ms").rowsBetween(-count, -1)


def funding_relative(rates: DataFrame, side: Column) -> DataFrame:
    """The rate's place among the 60 known rates strictly before, and what the plan's side pays."""
    df = place(rates.withColumns({"s": sign_of(side), "reference": F.collect_list("rate").over(before(REFERENCE))}), "rate", "reference")
    guards = [(F.abs("rate") < float("inf"), NO_FUNDING), (F.size("reference") == REFERENCE, FEW_FUNDINGS)]
    outputs = {"rate": F.col("rate"), "median": F.col("median"), "mad": F.col("mad"), "rank": F.col("rank"), "centered": 2 * F.col("rank") - 1, "robust_z_": F.col("robust_z"), "side_cost": F.col("s") * F.col("rate")}
    return df.select("symbol", "open_ms", ruled(outputs, guards).alias("funding"))


def crowding_relative(ratios: DataFrame, side: Column, step_ms: int) -> DataFrame:
    """The log ratio of long to short accounts among the 60 periods before, which have to follow each other without a gap.

    Rows without a positive ratio are left out first.
    """
    df = ratios.where((F.col("ratio") > 0) & (F.col("ratio") < float("inf"))).withColumns({"s": sign_of(side), "log_ratio": F.ln("ratio")})
    first = F.first("open_ms").over(before(REFERENCE))
    df = place(df.withColumns({"reference": F.collect_list("log_ratio").over(before(REFERENCE)), "first_ms": first}), "log_ratio", "reference")
    guards = [(F.size("reference") == REFERENCE, FEW_CROWDS), (F.col("open_ms") - F.col("first_ms") == REFERENCE * step_ms, GAPPED_CROWDS)]
    mine = F.when(F.col("s") > 0, F.col("rank")).otherwise(1 - F.col("rank"))
    outputs = {"log_ratio": F.col("log_ratio"), "median": F.col("median"), "mad": F.col("mad"), "rank": F.col("rank"), "centered": 2 * F.col("rank") - 1, "robust_z_": F.col("robust_z"), "side_rank": mine, "side_centered": 2 * mine - 1}
    return df.select("symbol", "open_ms", ruled(outputs, guards).alias("crowding"))


def volume_family(bars: DataFrame, horizon: int, side: Column, lookback: int = 60) -> DataFrame:
    """Relative volume, compression and absorption at each bar, against the 60 horizons behind.

    ATR is taken over the bar's last `lookback` bars; the flow is the horizon's taker buying against its taker selling.
    """
    h, w = back(horizon), before(REFERENCE, "phase")
    df = changes(bars).withColumns({"s": sign_of(side), "phase": F.col("n") % horizon, "volume_h": F.sum("quote_volume").over(h), "buy_h": F.sum("taker_buy_quote").over(h)})
    df = df.withColumns({"top": F.max("high").over(h), "bottom": F.min("low").over(h), "start": F.first("open").over(h), "_tr": F.collect_list("true_range").over(back(lookback)), "_sd": F.stddev_pop("close").over(back(20)), "_mean": F.avg("close").over(back(20))})
    df = df.withColumn("atr", F.when(F.col("n") >= 14, wilder_of(F.col("_tr"), 14))).drop("_tr")
    df = df.withColumns({"atr_fraction": F.col("atr") / F.col("close"), "width": F.when(F.col("n") >= 20, 4 * F.col("_sd") / F.col("_mean"))})
    names = ("volume_h", "atr_fraction", "width")
    df = df.withColumns({f"_{c}": F.collect_list(F.when(F.col("n") >= horizon, F.col(c))).over(w) for c in names})
    df = df.withColumn("median", median_of(F.col("_volume_h"))).withColumns({f"{c}_rank": midrank(F.col(c), F.col(f"_{c}")) for c in names})
    relative = F.col("volume_h") / F.col("median")
    volume = {"volume": F.col("volume_h"), "median": F.col("median"), "relative": relative, "rank": F.col("volume_h_rank"), "log_relative_": F.when(relative > 0, F.ln(relative))}
    df = df.withColumn("relative_volume", ruled(volume, [(F.size("_volume_h") == REFERENCE, FEW_VOLUMES), (F.col("median") > 0, ZERO_VOLUME)]))
    parent = F.col("relative_volume")
    squeezed = {"atr_fraction": F.col("atr_fraction"), "atr_rank": F.col("atr_fraction_rank"), "width": F.col("width"), "width_rank": F.col("width_rank"), "relative_volume": parent["relative"], "volume_rank": parent["rank"]}
    full = (F.size("_width") == REFERENCE) & (F.size("_atr_fraction") == REFERENCE)
    flow = F.when(F.col("volume_h") > 0, 2 * F.col("buy_h") / F.col("volume_h") - 1)
    df = df.withColumns({"compression": ruled(squeezed, [(full, FEW_ENDPOINTS)], [parent]), "flow": flow, "moved": F.ln(F.col("close") / F.col("start"))})
    span = F.col("top") - F.col("bottom")
    upper, lower = (F.col("top") - F.greatest("start", "close")) / span, (F.least("start", "close") - F.col("bottom")) / span
    displacement = F.col("moved") / F.col("atr_fraction")
    absorbed = {"flow": F.col("flow"), "side_flow": F.col("s") * F.col("flow"), "relative_volume": parent["relative"], "log_return": F.col("moved"), "displacement": displacement, "side_displacement": F.col("s") * displacement}
    absorbed |= {"upper_wick": upper, "lower_wick": lower, "opposing_wick_": F.when(F.col("flow") > 0, upper).when(F.col("flow") < 0, lower)}
    df = df.withColumn("absorption", ruled(absorbed, [(span > 0, ZERO_RANGE)], [parent]))
    return df.select("symbol", "open_ms", "relative_volume", "compression", "absorption")


def book_imbalance(levels: DataFrame, key: str, side: Column, top: tuple[int, ...] = TOP_LEVELS, bands: tuple[int, ...] = BANDS_BPS) -> DataFrame:
    """Imbalance of notional among a book's best levels and near its middle (levels: key, bid, price, qty).

    Levels without a positive price and quantity are left out; a crossed or one-sided book is blocked. Ranks and best prices
    are windows over one partitioning by book, which also serves the sums.
    """
    bid, worth = F.col("bid"), F.col("price") * F.col("qty")
    good = levels.where((F.col("price") > 0) & (F.col("qty") > 0)).withColumn("worth", worth)
    # bids from the highest price down, asks from the lowest up
    order = F.when(bid, -F.col("price")).otherwise(F.col("price")), F.when(bid, -F.col("qty")).otherwise(F.col("qty"))
    whole = Window.partitionBy(key)
    good = good.withColumns({"best_bid": F.max(F.when(bid, F.col("price"))).over(whole), "best_ask": F.min(F.when(~bid, F.col("price"))).over(whole)})
    good = good.withColumns({"r": F.row_number().over(Window.partitionBy(key, "bid").orderBy(*order)), "mid": (F.col("best_bid") + F.col("best_ask")) / 2})
    inside = {f"top_{n}": F.col("r") <= n for n in top}
    for b in bands:
        share = b / 10_000.0
        inside[f"within_{b}bps"] = F.when(bid, F.col("price") >= F.col("mid") * (1 - share)).otherwise(F.col("price") <= F.col("mid") * (1 + share))
    way = F.when(bid, F.col("worth")).otherwise(-F.col("worth"))
    sums = [f(F.when(c, x)).alias(f"{n}{tail}") for n, c in inside.items() for f, x, tail in ((F.sum, way, "_net"), (F.sum, F.col("worth"), "_all"))]
    books = good.groupBy(key).agg(F.max("best_bid").alias("best_bid"), F.max("best_ask").alias("best_ask"), F.max("mid").alias("mid"), *sums).withColumn("s", sign_of(side))
    outputs = {"mid": F.col("mid"), "spread": (F.col("best_ask") - F.col("best_bid")) / F.col("mid")}
    for n in inside:
        ratio = F.when(F.col(f"{n}_all") > 0, F.col(f"{n}_net") / F.col(f"{n}_all"))
        outputs |= {f"{n}_": ratio, f"side_{n}_": F.col("s") * ratio}
    return books.select(key, ruled(outputs, [(F.col("best_bid") < F.col("best_ask"), NO_BOOK)]).alias("book"))


def liquidation_zone(side: Column, entry: Column, target: Column, stop: Column, sigma: Column, above: Column, below: Column) -> Column:
    """Notional of the clusters (arrays of price and notional) on the way to either barrier, and the clusters nearest to them."""
    long = side == "long"
    ahead, behind = F.when(long, above).otherwise(below), F.when(long, below).otherwise(above)
    on_way = lambda clusters, barrier: F.filter(clusters, lambda c: (c["price"] >= F.least(entry, barrier)) & (c["price"] <= F.greatest(entry, barrier)))
    mass = lambda clusters: F.aggregate(clusters, F.lit(0.0), lambda acc, c: acc + c["notional"])
    nearest = lambda clusters, barrier: F.array_min(F.transform(clusters, lambda c: F.struct((F.abs(F.ln(c["price"] / barrier)) / sigma).alias("distance"), c["price"].alias("price"))))
    to_target, to_stop = on_way(ahead, target), on_way(behind, stop)
    target_mass, stop_mass = mass(to_target), mass(to_stop)
    ordered = F.when(long, (stop < entry) & (entry < target)).when(side == "short", (target < entry) & (entry < stop))
    guards = [(above.isNotNull() & below.isNotNull(), NO_CLUSTERS), ((F.least(entry, target, stop, sigma) > 0) & ordered, BAD_GEOMETRY)]
    outputs = {"target_count": F.size(to_target), "stop_count": F.size(to_stop), "target_mass": target_mass, "stop_mass": stop_mass, "target_share_": F.when(target_mass + stop_mass > 0, target_mass / (target_mass + stop_mass))}
    for name, found in (("target", nearest(to_target, target)), ("stop", nearest(to_stop, stop))):
        outputs |= {f"nearest_{name}_": found["price"], f"nearest_{name}_sigmas_": found["distance"]}
    return ruled(outputs, guards)


def dual_role(x: Column, side: Column) -> Column:
    """A measure as the waiting order's activation (against its side) and its reaction (with it) read it."""
    s = sign_of(side)
    return F.struct(x.alias("raw"), (-s * x).alias("activation"), (s * x).alias("reaction"))


def relation(x: Column) -> Column:
    return F.when(x > 0, "toward_direction").when(x < 0, "against_direction").otherwise("flat")


def activation_trajectory(side: Column, efficiency: Column, displacement: Column, windows: Column, slope: Column, rsi: Column) -> Column:
    """Path measures of a waiting order in both roles; windows is an array of efficiencies, slope and rsi may be missing."""
    s = sign_of(side)
    toward = F.transform(windows, lambda x: -s * x)
    outputs = {"path": -s * efficiency, "reaction_path": s * efficiency, "path_relation_": relation(-s * efficiency), "displacement": -s * displacement, "reaction_displacement": s * displacement}
    outputs |= {"toward": F.size(F.filter(toward, lambda x: x > 0)), "away": F.size(F.filter(toward, lambda x: x < 0)), "slope_": -s * slope, "rsi_": -s * rsi}
    return ruled(outputs, [(F.forall(windows, lambda x: x.isNotNull()), "trajectory_parent_output_invalid")])


def flow_dual_role(side: Column, directional: dict[str, Column], context: dict[str, Column]) -> Column:
    """Flow measures in both roles, never summed, and measures without direction; blocked only where all are missing."""
    outputs = {}
    for name, x in directional.items():
        both = dual_role(x, side)
        outputs |= {f"{name}_activation_": both["activation"], f"{name}_reaction_": both["reaction"]}
    outputs |= {f"{name}_": x for name, x in context.items()}
    return ruled(outputs, [(F.coalesce(*directional.values(), *context.values()).isNotNull(), NO_FLOW)])


def marked_pivots(bars: DataFrame, half: int) -> DataFrame:
    """bars (with n) and each bar's pivot: kind, price and prominence in price; of a bar that is both, the more prominent one."""
    w = Window.partitionBy("symbol").orderBy("open_ms")
    sides = (w.rowsBetween(-half, -1), w.rowsBetween(1, half))
    full = F.count("*").over(w.rowsBetween(-half, half)) == 2 * half + 1
    tops, bottoms = ([f(c).over(x) for x in sides] for f, c in ((F.max, "high"), (F.min, "low")))
    df = bars.withColumns({"_cap": F.least(*tops), "_lid": F.greatest(*tops), "_base": F.greatest(*bottoms), "_floor": F.least(*bottoms), "_full": full})
    high, low = F.col("_full") & (F.col("high") > F.col("_lid")), F.col("_full") & (F.col("low") < F.col("_floor"))
    up, down = F.col("high") - F.col("_base"), F.col("_cap") - F.col("low")
    pivot = lambda kind, price, much: F.struct(F.lit(kind).alias("kind"), F.col("n").alias("n"), F.col(price).alias("price"), much.alias("prominence"))
    found = F.when(high & (~low | (up >= down)), pivot("high", "high", up)).when(low, pivot("low", "low", down))
    return df.withColumn("pivot", found).drop("_cap", "_lid", "_base", "_floor", "_full")


def structural_levels(plans: DataFrame, horizon: int, half: int = 3) -> DataFrame:
    """Confirmed pivots of the last four horizons about each bar's plan (side, entry, target, stop beside the bar), and what they
    mean to an order that waits at the entry: a long one wants a support there, a short one a resistance.

    A pivot counts only if all bars that confirm it lie within the context; nearest levels tie to the earlier one.
    """
    span = 4 * horizon
    df = changes(plans).withColumns({"s": sign_of(F.col("side")), "sigma": F.sqrt(F.sum(F.col("ret") * F.col("ret")).over(back(horizon))), "_range": F.first(F.col("high") - F.col("low")).over(back(span)), "_tr": F.collect_list("true_range").over(back(span))})
    frame = Window.partitionBy("symbol").orderBy("open_ms").rowsBetween(half + 1 - span, -half)
    df = marked_pivots(df, half).withColumns({"levels": F.collect_list("pivot").over(frame), "atr": wilder_of(F.concat(F.array("_range"), F.slice("_tr", 2, span)), 14)})
    entry, levels, long = F.col("entry"), F.col("levels"), F.col("s") > 0
    supports = F.filter(levels, lambda x: (x["kind"] == "low") & (x["price"] < entry))
    resistances = F.filter(levels, lambda x: (x["kind"] == "high") & (x["price"] > entry))
    on_way = lambda kind, barrier: F.filter(levels, lambda x: (x["kind"] == kind) & (x["price"] > F.least(entry, barrier)) & (x["price"] < F.greatest(entry, barrier)))
    nearest = lambda found: F.array_min(F.transform(found, lambda x: F.struct(F.abs(F.ln(x["price"] / entry)).alias("distance"), x["n"].alias("n"), x["price"].alias("price"), x["prominence"].alias("prominence"))))
    most = lambda found: F.array_max(F.transform(found, lambda x: x["prominence"]))
    df = df.withColumns({"supports": supports, "resistances": resistances, "ahead": on_way(F.when(long, "high").otherwise("low"), F.col("target")), "behind": on_way(F.when(long, "low").otherwise("high"), F.col("stop"))})
    df = df.withColumns({"support": nearest(F.col("supports")), "resistance": nearest(F.col("resistances"))})
    wanted = F.when(long, F.col("support")).otherwise(F.col("resistance"))
    counts = {"pivots": levels, "supports": F.col("supports"), "resistances": F.col("resistances"), "target_path": F.col("ahead"), "stop_path": F.col("behind")}
    outputs = {n: F.size(x) for n, x in counts.items()}
    for n in ("support", "resistance"):
        outputs |= {f"{n}_": F.col(n)["price"], f"{n}_sigmas_": F.col(n)["distance"] / F.col("sigma")}
    outputs |= {"target_prominence_": most(F.col("ahead")) / F.col("atr"), "stop_prominence_": most(F.col("behind")) / F.col("atr")}
    guards = [(F.col("n") >= span, FEW_CONTEXT), (F.col("sigma") > 0, NO_SIGMA), (F.size(levels) > 0, NO_PIVOTS)]
    df = df.withColumns({"structure": ruled(outputs, guards), "wanted": wanted})
    at = F.col("wanted")
    zone = {"level_type_": F.when(long, "support").otherwise("resistance"), "has_level_": at.isNotNull(), "level_": at["price"], "level_sigmas_": at["distance"] / F.col("sigma"), "prominence_": at["prominence"] / F.col("atr"), "target_path": F.size("ahead"), "stop_path": F.size("behind")}
    return df.withColumn("zone", ruled(zone, [], [F.col("structure")])).select("symbol", "open_ms", "structure", "zone")


def pullback(side: Column, trend: Column, extension: Column, volume: Column, absorption: Column, structure: Column) -> Column:
    """The measures of trend, extension, volume, flow and structure side by side, where all their rules are evaluated."""
    outputs = {"trend": trend["side_far"], "slope": trend["side_slope"], "extension": extension["side_extension"], "relative_volume": volume["relative"], "volume_rank": volume["rank"]}
    outputs |= {"flow": sign_of(side) * absorption["flow"], "target_path": structure["target_path"], "stop_path": structure["stop_path"]}
    return ruled(outputs, [], [trend, extension, volume, absorption, structure])


def liquidation_path(side: Column, price: Column, entry: Column, target: Column, stop: Column, sigma: Column, above: Column, below: Column) -> Column:
    """Clusters on the way from the price to a waiting order's entry, from there on to its stop, and to its target.

    Clusters below hold long positions, those above short ones. The entry itself belongs to the approach alone.
    """
    long = side == "long"
    own, other = F.when(long, below).otherwise(above), F.when(long, above).otherwise(below)
    # distance from the entry against the order's side, so that both sides read alike
    against = lambda x: -sign_of(side) * (x - entry)
    summed = {
        "approach": F.filter(own, lambda c: (against(c["price"]) <= 0) & (against(c["price"]) >= against(price))),
        "overshoot": F.filter(own, lambda c: (against(c["price"]) > 0) & (against(c["price"]) <= against(stop))),
        "target": F.filter(other, lambda c: (against(c["price"]) < 0) & (against(c["price"]) >= against(target))),
    }
    outputs, mass = {}, {}
    for name, found in summed.items():
        mass[name] = F.aggregate(found, F.lit(0.0), lambda acc, c: acc + c["notional"])
        near = F.array_min(F.transform(found, lambda c: F.struct((F.abs(F.ln(c["price"] / entry)) / sigma).alias("distance"), c["price"].alias("price"))))
        outputs |= {f"{name}_count": F.size(found), f"{name}_mass": mass[name], f"{name}_nearest_": near["price"], f"{name}_sigmas_": near["distance"]}
    after = mass["overshoot"] + mass["target"]
    outputs["target_share_"] = F.when(after > 0, mass["target"] / after)
    return ruled(outputs, [(above.isNotNull() & below.isNotNull(), NO_CLUSTERS), ((F.least(price, entry, target, stop, sigma) > 0) & side.isin("long", "short"), BAD_GEOMETRY)])


def family_state(traces: list[Column]) -> Column:
    """A family's state: whether all, some or none of its rules are evaluated, and their number."""
    n = sum((F.when(t["status"] == "evaluated", 1).otherwise(0) for t in traces), F.lit(0))
    state = F.when(n == len(traces), "evaluated").when(n > 0, "partially_evaluated").otherwise("blocked")
    return F.struct(state.alias("state"), n.alias("evaluated"))


def required_bars(horizon_s: int, interval_s: int) -> int:
    """Bars that rules against 60 earlier horizons need: 61 horizons of returns, and the bar before them."""
    return (REFERENCE + 1) * (horizon_s // interval_s) + 1
