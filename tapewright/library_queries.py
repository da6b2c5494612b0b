"""Queries of the library rules over hourly bars, lines as book levels and orders as plans, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.catalog import _BARS, _CHANGES, HOUR, SQL, hourly, query, rounded
from tapewright.plans import library_rules as L
from tapewright.rule_queries import _CASES, cases

_SIDE = "CASE WHEN (open_ms // 3600000) % 2 = 0 THEN 1 ELSE -1 END"


def bar_side() -> Column:
    return F.when(F.pmod(F.floor(F.col("open_ms") / HOUR), F.lit(2)) == 0, "long").otherwise("short")


def flat(df: DataFrame, keys: list[str], traces: dict[str, str]) -> DataFrame:
    """Keys and every field of the traces, by the trace's short name."""
    fields = [F.col(f"{t}.{f}").alias(f"{short}_{f}") for t, short in traces.items() for f in df.schema[t].dataType.names]
    return rounded(df.select(*keys, *fields))


_COUNTS = ("approach_count", "overshoot_count", "target_count", "stop_count", "toward", "away", "pivots", "supports", "resistances", "target_path", "stop_path")


def _when(ok: str, fields: dict[str, str], short: str) -> str:
    return ", ".join(f"CASE WHEN {ok} THEN {f'CAST({x} AS INTEGER)' if n in _COUNTS else f'round(CAST({x} AS DOUBLE), 6)'} END AS {short}_{n}" for n, x in fields.items())


def _status(checks: list[tuple[str, str]], short: str) -> str:
    """status and reason columns from (condition that holds, reason) in order."""
    good = " AND ".join(f"coalesce({c}, false)" for c, _ in checks)
    why = " ".join(f"WHEN NOT coalesce({c}, false) THEN '{r}'" for c, r in checks)
    return f"CASE WHEN {good} THEN 'evaluated' ELSE 'blocked' END AS {short}_status, CASE {why} END AS {short}_reason"


def _ema(c: str, p: int) -> str:
    return f"list_reduce(list_concat([list_avg({c}[1:{p}])], {c}[{p + 1}:]), lambda x, y: x + (2.0::DOUBLE / {p + 1}) * (y - x))"


def _wilder(c: str, p: int = 14) -> str:
    return f"list_reduce(list_concat([list_avg({c}[1:{p}])], {c}[{p + 1}:]), lambda x, y: (x * {p - 1} + y) / {p})"


_TREND = {"ema50": "ema50", "ema200": "ema200", "slope": "slope", "near": "near", "far": "far", "side_slope": "s * slope", "side_near": "s * near", "side_far": "s * far"}
_RSI = {"rsi": "rsi", "centered": "(rsi - 50) / 50", "side_centered": "s * (rsi - 50) / 50"}
_EXT = {"ema20": "ema20", "atr": "atr", "atr_fraction": "atr / close", "extension": "extension", "side_extension": "s * extension"}
_TECHNICAL = [("n >= 206", L.NO_TECHNICAL), ("atr > 0", L.NO_ATR)]


@query(
    f"""WITH {_CHANGES}, l AS (SELECT symbol, open_ms, close, n, {_SIDE} AS s, first(high - low) OVER w AS hl, list(close) OVER w AS c, list(change) OVER w AS d, list(true_range) OVER w AS r
  FROM ch WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS 205 PRECEDING)
), k AS (SELECT symbol, open_ms, close, n, s, c, d[2:] AS d, list_concat([hl], r[2:]) AS r FROM l WHERE n >= 206
), e AS (SELECT symbol, open_ms, {_ema("c", 20)} AS ema20, {_ema("c", 50)} AS ema50, {_ema("c", 200)} AS ema200, {_ema("c[1:200]", 50)} AS before, {_wilder("r")} AS atr,
  {_wilder("list_transform(d, lambda x: greatest(x, 0))")} AS up, {_wilder("list_transform(d, lambda x: greatest(-x, 0))")} AS down FROM k
), f AS (SELECT l.symbol, l.open_ms, close, n, s, ema20, ema50, ema200, atr, CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi, (ema50 - before) / atr AS slope, (close - ema20) / atr AS extension,
  ln(close / ema50) AS near, ln(ema50 / ema200) AS far FROM l LEFT JOIN e ON l.symbol = e.symbol AND l.open_ms = e.open_ms)
SELECT symbol, open_ms, {_status(_TECHNICAL, "trend")}, {_when("n >= 206 AND atr > 0", _TREND, "trend")}, {_status(_TECHNICAL, "rsi")}, {_when("n >= 206 AND atr > 0", _RSI, "rsi")},
  {_status([("n >= 206 AND atr > 0", "dependency_not_evaluated")], "ext")}, {_when("n >= 206 AND atr > 0", _EXT, "ext")} FROM f"""
)
def technical_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EMA trend, RSI and extension at each hourly bar, long and short by turns."""
    return flat(L.technical(hourly(spark, sf_dir), bar_side()), ["symbol", "open_ms"], {"ema_trend": "trend", "rsi_wilder": "rsi", "atr_extension": "ext"})


_PLACED = """m AS (SELECT *, list_median(ref) AS median FROM r), p AS (SELECT *, list_median(list_transform(ref, lambda x: abs(x - median))) AS mad FROM m
), q AS (SELECT *, (len(list_filter(ref, lambda x: x < v)) + 0.5 * len(list_filter(ref, lambda x: x = v))) / nullif(len(ref), 0) AS rank, CASE WHEN mad > 0 THEN (v - median) / (1.4826::DOUBLE * mad) END AS z FROM p)"""
_FUNDED = "v IS NOT NULL AND len(ref) = 60"


@query(
    f"""WITH {_CHANGES}, r AS (SELECT symbol, open_ms, {_SIDE} AS s, ret AS v, coalesce(list_filter(list(ret) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL), []) AS ref FROM ch
), {_PLACED} SELECT symbol, open_ms, {_status([("v IS NOT NULL", L.NO_FUNDING), ("len(ref) = 60", L.FEW_FUNDINGS)], "funding")},
  {_when(_FUNDED, {"rate": "v", "median": "median", "mad": "mad", "rank": "rank", "centered": "2 * rank - 1", "robust_z": "z", "side_cost": "s * v"}, "funding")} FROM q"""
)
def funding_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's log return as a rate among the 60 before."""
    rates = hourly(spark, sf_dir)
    rates = L.changes(rates).select("symbol", "open_ms", F.col("ret").alias("rate"))
    return flat(L.funding_relative(rates, bar_side()), ["symbol", "open_ms"], {"funding": "funding"})


_CROWD = "len(ref) = 60 AND open_ms - first_ms = 60 * 3600000"
_CROWDED = {"log_ratio": "v", "median": "median", "mad": "mad", "rank": "rank", "centered": "2 * rank - 1", "robust_z": "z", "side_rank": "CASE WHEN s > 0 THEN rank ELSE 1 - rank END", "side_centered": "2 * CASE WHEN s > 0 THEN rank ELSE 1 - rank END - 1"}


@query(
    f"""WITH {_BARS}, r AS (SELECT symbol, open_ms, {_SIDE} AS s, ln(volume / n_trades) AS v, coalesce(list(ln(volume / n_trades)) OVER w, []) AS ref, first(open_ms) OVER w AS first_ms
  FROM bars WHERE volume / n_trades > 1 WINDOW w AS (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)
), {_PLACED} SELECT symbol, open_ms, {_status([("len(ref) = 60", L.FEW_CROWDS), ("open_ms - first_ms = 60 * 3600000", L.GAPPED_CROWDS)], "crowding")}, {_when(_CROWD, _CROWDED, "crowding")} FROM q"""
)
def crowding_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's mean trade as a ratio among the 60 periods before; bars of trades of one unit have none."""
    ratio = F.col("volume") / F.col("n_trades")
    ratios = hourly(spark, sf_dir).select("symbol", "open_ms", F.when(ratio > 1, ratio).alias("ratio"))
    return flat(L.crowding_relative(ratios, bar_side(), HOUR), ["symbol", "open_ms"], {"crowding": "crowding"})


_VOLUME_OK = "len(vs) = 60 AND med > 0"
_FULL = "len(ws) = 60 AND len(fs) = 60 AND x1 IS NOT NULL AND x2 IS NOT NULL"


def _rank(x: str, ref: str) -> str:
    return f"(len(list_filter({ref}, lambda y: y < {x})) + 0.5 * len(list_filter({ref}, lambda y: y = {x}))) / nullif(len({ref}), 0)"


_SQUEEZED = {"atr_fraction": "x1", "atr_rank": _rank("x1", "fs"), "width": "x2", "width_rank": _rank("x2", "ws"), "relative_volume": "vh / med", "volume_rank": _rank("vh", "vs")}
_ABSORBED = {"flow": "flow", "side_flow": "s * flow", "relative_volume": "vh / med", "log_return": "moved", "displacement": "moved / x1", "side_displacement": "s * moved / x1", "upper_wick": "upper", "lower_wick": "lower", "opposing_wick": "CASE WHEN flow > 0 THEN upper WHEN flow < 0 THEN lower END"}


@query(
    f"""WITH {_CHANGES}, a AS (SELECT *, {_SIDE} AS s, sum(quote_volume) OVER h AS vh, sum(taker_buy_quote) OVER h AS bh, max(high) OVER h AS top, min(low) OVER h AS bottom, first(open) OVER h AS start, list(true_range) OVER w60 AS trs, stddev_pop(close) OVER w20 AS sd, avg(close) OVER w20 AS mean
  FROM ch WINDOW h AS (PARTITION BY symbol ORDER BY open_ms ROWS 1 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY open_ms ROWS 59 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY open_ms ROWS 19 PRECEDING)
), b AS (SELECT *, CASE WHEN n >= 14 THEN {_wilder("trs")} END / close AS x1, CASE WHEN n >= 20 THEN 4 * sd / mean END AS x2 FROM a
), c AS (SELECT *, list_filter(coalesce(list(CASE WHEN n >= 2 THEN vh END) OVER w, []), lambda x: x IS NOT NULL) AS vs, list_filter(coalesce(list(x1) OVER w, []), lambda x: x IS NOT NULL) AS fs, list_filter(coalesce(list(x2) OVER w, []), lambda x: x IS NOT NULL) AS ws
  FROM b WINDOW w AS (PARTITION BY symbol, n % 2 ORDER BY open_ms ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)
), d AS (SELECT *, list_median(vs) AS med, CASE WHEN vh > 0 THEN 2 * bh / vh - 1 END AS flow, ln(close / start) AS moved, (top - greatest(start, close)) / (top - bottom) AS upper, (least(start, close) - bottom) / (top - bottom) AS lower FROM c)
SELECT symbol, open_ms, {_status([("len(vs) = 60", L.FEW_VOLUMES), ("med > 0", L.ZERO_VOLUME)], "volume")},
  {_when(_VOLUME_OK, {"volume": "vh", "median": "med", "relative": "vh / med", "rank": _rank("vh", "vs"), "log_relative": "ln(vh / med)"}, "volume")},
  {_status([(_VOLUME_OK, "dependency_not_evaluated"), ("len(ws) = 60 AND len(fs) = 60", L.FEW_ENDPOINTS)], "squeeze")}, {_when(f"{_VOLUME_OK} AND {_FULL}", _SQUEEZED, "squeeze")},
  {_status([(_VOLUME_OK, "dependency_not_evaluated"), ("top > bottom", L.ZERO_RANGE)], "absorb")}, {_when(f"{_VOLUME_OK} AND top > bottom", _ABSORBED, "absorb")} FROM d"""
)
def volume_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative volume, compression and absorption at each hourly bar, for horizons of two bars."""
    return flat(L.volume_family(hourly(spark, sf_dir), 2, bar_side()), ["symbol", "open_ms"], {"relative_volume": "volume", "compression": "squeeze", "absorption": "absorb"})


_BOOK_SUMS = ", ".join(f"sum(CASE WHEN bid THEN worth ELSE -worth END) FILTER ({c}) / sum(worth) FILTER ({c}) AS {n}" for n, c in {"top_5": "r <= 5", "top_20": "r <= 20", **{f"within_{b}bps": f"CASE WHEN bid THEN price >= mid * (1 - CAST({b / 10_000} AS DOUBLE)) ELSE price <= mid * (1 + CAST({b / 10_000} AS DOUBLE)) END" for b in (10, 20, 50)}}.items())
_BOOK_NAMES = ["top_5", "top_20", "within_10bps", "within_20bps", "within_50bps"]
_BOOK_OUT = {"mid": "mid", "spread": "(best_ask - best_bid) / mid"} | {f: x for n in _BOOK_NAMES for f, x in ((n, n), (f"side_{n}", f"s * {n}"))}


@query(
    f"""WITH l AS (SELECT l_suppkey AS book_id, l_linenumber % 2 = 1 AS bid, CASE WHEN l_linenumber % 2 = 1 THEN 100 - CAST(l_partkey % 50 + l_suppkey % 3 * 30 - 25 AS DOUBLE) / 64 ELSE 100 + CAST(l_partkey % 47 AS DOUBLE) / 64 END AS price, CAST(l_quantity AS DOUBLE) AS qty FROM lineitem
), b AS (SELECT *, price * qty AS worth, max(CASE WHEN bid THEN price END) OVER k AS best_bid, min(CASE WHEN NOT bid THEN price END) OVER k AS best_ask, row_number() OVER (PARTITION BY book_id, bid ORDER BY CASE WHEN bid THEN -price ELSE price END, CASE WHEN bid THEN -qty ELSE qty END) AS r
  FROM l WINDOW k AS (PARTITION BY book_id)
), m AS (SELECT *, (best_bid + best_ask) / 2 AS mid FROM b), g AS (SELECT book_id, max(best_bid) AS best_bid, max(best_ask) AS best_ask, max(mid) AS mid, CASE WHEN book_id % 2 = 0 THEN 1 ELSE -1 END AS s, {_BOOK_SUMS} FROM m GROUP BY book_id)
SELECT book_id, {_status([("best_bid < best_ask", L.NO_BOOK)], "book")}, {_when("best_bid < best_ask", _BOOK_OUT, "book")} FROM g"""
)
def order_book_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's lines as a book, odd lines bid and even lines ask; some books are crossed."""
    bid, part = F.col("l_linenumber") % 2 == 1, F.col("l_partkey")
    price = F.when(bid, 100 - (part % 50 + F.col("l_suppkey") % 3 * 30 - 25).cast("double") / 64).otherwise(100 + (part % 47).cast("double") / 64)
    levels = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("book_id"), bid.alias("bid"), price.alias("price"), F.col("l_quantity").cast("double").alias("qty"))
    side = F.when(F.col("book_id") % 2 == 0, "long").otherwise("short")
    return flat(L.book_imbalance(levels, "book_id", side), ["book_id"], {"book": "book"})


_ZONE_PLAN = """z AS (SELECT *, entry * (1 + s * 0.5::DOUBLE) AS target, entry * (1 - s * 0.25::DOUBLE) * CASE WHEN close_at_high THEN 2 ELSE 1 END AS stop, 0.25::DOUBLE AS sigma, n_trades = 1 AS none,
  [{'price': hi, 'notional': volume}, {'price': mean20 * 1.1::DOUBLE, 'notional': CAST(n_trades AS DOUBLE)}, {'price': coalesce(old, entry * 1.25::DOUBLE), 'notional': 2::DOUBLE}] AS up,
  [{'price': lo, 'notional': volume}, {'price': mean20 * 0.9::DOUBLE, 'notional': CAST(n_trades AS DOUBLE)}] AS down FROM (SELECT *, entry = high AND n_trades > 3 AS close_at_high FROM c))"""
_ZONE_OK = "NOT none AND CASE WHEN side = 'long' THEN stop < entry AND entry < target ELSE target < entry AND entry < stop END"
_ZONE_OUT = {"target_count": "len(ta)", "stop_count": "len(sa)", "target_mass": "tm", "stop_mass": "sm", "target_share": "tm / nullif(tm + sm, 0)", "nearest_target": "tn.price", "nearest_target_sigmas": "tn.distance", "nearest_stop": "sn.price", "nearest_stop_sigmas": "sn.distance"}


def _nearest(found: str, barrier: str) -> str:
    return f"list_min(list_transform({found}, lambda c: {{'distance': abs(ln(c.price / {barrier})) / sigma, 'price': c.price}}))"


@query(
    f"""WITH {_CASES}, {_ZONE_PLAN}, y AS (SELECT *, list_filter(CASE WHEN side = 'long' THEN up ELSE down END, lambda c: c.price BETWEEN least(entry, target) AND greatest(entry, target)) AS ta, list_filter(CASE WHEN side = 'long' THEN down ELSE up END, lambda c: c.price BETWEEN least(entry, stop) AND greatest(entry, stop)) AS sa FROM z
), x AS (SELECT *, coalesce(list_sum(list_transform(ta, lambda c: c.notional)), 0) AS tm, coalesce(list_sum(list_transform(sa, lambda c: c.notional)), 0) AS sm, {_nearest("ta", "target")} AS tn, {_nearest("sa", "stop")} AS sn FROM y)
SELECT k, {_status([("NOT none", L.NO_CLUSTERS), (_ZONE_OK, L.BAD_GEOMETRY)], "zone")}, {_when(_ZONE_OK, _ZONE_OUT, "zone")} FROM x"""
)
def liquidation_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters about each case's entry, counted on the way to its barriers; some cases have none or wrong barriers."""
    zone = L.liquidation_zone(*[F.col(c) for c in ("side", "entry", "target", "stop")], F.lit(0.25), F.col("up"), F.col("down"))
    return flat(_zone_plans(spark, sf_dir).select("k", zone.alias("zone")), ["k"], {"zone": "zone"})


def _zone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, entry, s = F.col, F.col("entry"), F.col("s")
    one = lambda price, n: F.struct(price.alias("price"), n.cast("double").alias("notional"))
    up = F.array(one(col("hi"), col("volume")), one(col("mean20") * 1.1, col("n_trades")), one(F.coalesce("old", entry * 1.25), F.lit(2)))
    down = F.array(one(col("lo"), col("volume")), one(col("mean20") * 0.9, col("n_trades")))
    some = col("n_trades") > 1
    target, stop = entry * (1 + s * 0.5), entry * (1 - s * 0.25) * F.when((entry == col("high")) & (col("n_trades") > 3), 2).otherwise(1)
    price, wait, far = F.coalesce("next_close", entry), entry * (1 - s / 8.0), entry * (1 - s / 2.0)
    return cases(spark, sf_dir).select("k", "side", "entry", target.alias("target"), stop.alias("stop"), price.alias("price"), wait.alias("wait"), far.alias("far"), F.when(some, up).alias("up"), F.when(some, down).alias("down"))


_WAYS = {"approach": ("own", "-s * (c.price - wait) <= 0 AND -s * (c.price - wait) >= -s * (price - wait)"), "overshoot": ("own", "-s * (c.price - wait) > 0 AND -s * (c.price - wait) <= -s * (far - wait)"), "target": ("other", "-s * (c.price - wait) < 0 AND -s * (c.price - wait) >= -s * (target - wait)")}
_WAY_OUT = {f"{n}_{f}": x for n in _WAYS for f, x in (("count", f"len({n}_)"), ("mass", f"{n}_m"), ("nearest", f"{n}_n.price"), ("sigmas", f"{n}_n.distance"))} | {"target_share": "target_m / nullif(overshoot_m + target_m, 0)"}


@query(
    f"""WITH {_CASES}, {_ZONE_PLAN}, y AS (SELECT *, coalesce(next_close, entry) AS price, entry * (1 - s / 8.0::DOUBLE) AS wait, entry * (1 - s / 2.0::DOUBLE) AS far, CASE WHEN s > 0 THEN down ELSE up END AS own, CASE WHEN s > 0 THEN up ELSE down END AS other FROM z
), x AS (SELECT *, {", ".join(f"list_filter({a}, lambda c: {c}) AS {n}_" for n, (a, c) in _WAYS.items())} FROM y
), w AS (SELECT *, {", ".join(f"coalesce(list_sum(list_transform({n}_, lambda c: c.notional)), 0) AS {n}_m, {_nearest(f'{n}_', 'wait')} AS {n}_n" for n in _WAYS)} FROM x)
SELECT k, {_status([("NOT none", L.NO_CLUSTERS)], "path")}, {_when("NOT none", _WAY_OUT, "path")} FROM w"""
)
def liquidation_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters on each waiting order's approach, overshoot and way to the target."""
    path = L.liquidation_path(*[F.col(c) for c in ("side", "price", "wait", "target", "far")], F.lit(0.25), F.col("up"), F.col("down"))
    return flat(_zone_plans(spark, sf_dir).select("k", path.alias("path")), ["k"], {"path": "path"})


_E = "CASE WHEN n > 24 THEN from_ema END"
_TRAJECTORY = {"path": "-s * change / 4", "reaction_path": "s * change / 4", "displacement": "-s * median_change", "reaction_displacement": "s * median_change", "toward": "len(list_filter(es, lambda x: -s * x > 0))", "away": "len(list_filter(es, lambda x: -s * x < 0))", "slope": "-s * from_ema", "rsi": "-s * (rsi - 50) / 50"}
_BOTH = {"flow": "taker", "cvd": "cvd"}
_CONTEXT = {"interest": "interest", "funding": "funding", "crowd": "crowd"}
_ANY = "coalesce(taker, cvd, interest, funding, crowd) IS NOT NULL"
_ROLES = {f"{n}_{role}": f"{sign}s * {x}" for n, x in _BOTH.items() for role, sign in (("activation", "-"), ("reaction", ""))} | _CONTEXT


@query(
    f"""WITH {_CASES}, t AS (SELECT *, [change, {_E}, median_change] AS es, ({_E}) IS NOT NULL AS ok FROM c)
SELECT k, {_status([("ok", "trajectory_parent_output_invalid")], "wait")}, {_when("ok", _TRAJECTORY, "wait")}, CASE WHEN ok THEN CASE WHEN -s * change > 0 THEN 'toward_direction' WHEN -s * change < 0 THEN 'against_direction' ELSE 'flat' END END AS wait_path_relation,
  {_status([(_ANY, L.NO_FLOW)], "roles")}, {_when(_ANY, _ROLES, "roles")} FROM t"""
)
def waiting_order_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for an order's entry: path and flow measures as its activation and its reaction read them."""
    col = F.col
    windows = F.array(col("change"), F.when(col("n") > 24, col("from_ema")), col("median_change"))
    wait = L.activation_trajectory(col("side"), col("change") / 4, col("median_change"), windows, col("from_ema"), (col("rsi") - 50) / 50)
    roles = L.flow_dual_role(col("side"), {n: col(x) for n, x in _BOTH.items()}, {n: col(x) for n, x in _CONTEXT.items()})
    return flat(cases(spark, sf_dir).select("k", wait.alias("wait"), roles.alias("roles")), ["k"], {"wait": "wait", "roles": "roles"})


_PLANNED = """CASE WHEN s > 0 THEN close * 1.5::DOUBLE ELSE close * 0.75::DOUBLE END AS target, CASE WHEN s > 0 THEN close * 0.75::DOUBLE ELSE close * 1.5::DOUBLE END AS stop"""
_MARKED = "n >= 4 AND nr = 3"
_UP, _DOWN = "high - greatest(bl, br)", "least(tl, tr) - low"
_HIGH, _LOW = f"({_MARKED} AND high > greatest(tl, tr))", f"({_MARKED} AND low < least(bl, br))"


def _pivot(kind: str, price: str, much: str) -> str:
    return f"{{'kind': '{kind}', 'n': n, 'price': {price}, 'prominence': {much}}}"


def _nearest_level(found: str) -> str:
    return f"list_min(list_transform({found}, lambda x: {{'distance': abs(ln(x.price / close)), 'n': x.n, 'price': x.price, 'prominence': x.prominence}}))"


_STRUCTURE = [("n >= 24", L.FEW_CONTEXT), ("sigma > 0", L.NO_SIGMA), ("len(lv) > 0", L.NO_PIVOTS)]
_STRUCTURED = {"pivots": "len(lv)", "supports": "len(su)", "resistances": "len(re)", "target_path": "len(ah)", "stop_path": "len(be)", "support": "ns.price", "support_sigmas": "ns.distance / sigma", "resistance": "nr_.price", "resistance_sigmas": "nr_.distance / sigma"}
_STRUCTURED |= {f"{n}_prominence": f"list_max(list_transform({x}, lambda y: y.prominence)) / atr" for n, x in (("target", "ah"), ("stop", "be"))}
_ZONED = {"level": "wa.price", "level_sigmas": "wa.distance / sigma", "prominence": "wa.prominence / atr", "target_path": "len(ah)", "stop_path": "len(be)"}
_OK = "n >= 24 AND sigma > 0 AND len(lv) > 0"


@query(
    f"""WITH {_CHANGES}, a AS (SELECT *, {_SIDE} AS s, sqrt(sum(ret * ret) OVER (PARTITION BY symbol ORDER BY open_ms ROWS 5 PRECEDING)) AS sigma, first(high - low) OVER c AS hl, list(true_range) OVER c AS trs, max(high) OVER l AS tl, max(high) OVER r AS tr, min(low) OVER l AS bl, min(low) OVER r AS br, count(*) OVER r AS nr
  FROM ch WINDOW c AS (PARTITION BY symbol ORDER BY open_ms ROWS 23 PRECEDING), l AS (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)
), b AS (SELECT *, {_PLANNED}, {_wilder("list_concat([hl], trs[2:])")} AS atr, CASE WHEN {_HIGH} AND (NOT {_LOW} OR {_UP} >= {_DOWN}) THEN {_pivot("high", "high", _UP)} WHEN {_LOW} THEN {_pivot("low", "low", _DOWN)} END AS pv FROM a
), d AS (SELECT *, list_filter(coalesce(list(pv) OVER (PARTITION BY symbol ORDER BY open_ms ROWS BETWEEN 20 PRECEDING AND 3 PRECEDING), []), lambda x: x IS NOT NULL) AS lv FROM b
), e AS (SELECT *, list_filter(lv, lambda x: x.kind = 'low' AND x.price < close) AS su, list_filter(lv, lambda x: x.kind = 'high' AND x.price > close) AS re, list_filter(lv, lambda x: x.kind = CASE WHEN s > 0 THEN 'high' ELSE 'low' END AND x.price > least(close, target) AND x.price < greatest(close, target)) AS ah,
  list_filter(lv, lambda x: x.kind = CASE WHEN s > 0 THEN 'low' ELSE 'high' END AND x.price > least(close, stop) AND x.price < greatest(close, stop)) AS be FROM d
), f AS (SELECT *, {_nearest_level("su")} AS ns, {_nearest_level("re")} AS nr_ FROM e), g AS (SELECT *, CASE WHEN s > 0 THEN ns ELSE nr_ END AS wa FROM f)
SELECT symbol, open_ms, {_status(_STRUCTURE, "structure")}, {_when(_OK, _STRUCTURED, "structure")}, {_status([(_OK, "dependency_not_evaluated")], "zone")}, {_when(_OK, _ZONED, "zone")},
  CASE WHEN {_OK} THEN CASE WHEN s > 0 THEN 'support' ELSE 'resistance' END END AS zone_level_type, CASE WHEN {_OK} THEN wa IS NOT NULL END AS zone_has_level FROM g"""
)
def structural_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots of the last 24 bars about a plan at each hourly bar's close."""
    return flat(_structure(spark, sf_dir), ["symbol", "open_ms"], {"structure": "structure", "zone": "zone"})


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    close = F.col("close")
    bars = hourly(spark, sf_dir).withColumns({"side": bar_side(), "entry": close})
    long = F.col("side") == "long"
    near, far = close * 0.75, close * 1.5
    return L.structural_levels(bars.withColumns({"target": F.when(long, far).otherwise(near), "stop": F.when(long, near).otherwise(far)}), 6)


_PULLED = {"trend": "trend_side_far", "slope": "trend_side_slope", "extension": "ext_side_extension", "relative_volume": "volume_relative", "volume_rank": "volume_rank", "flow": "absorb_side_flow", "target_path": "structure_target_path", "stop_path": "structure_stop_path"}
_ALL = " AND ".join(f"{t}_status = 'evaluated'" for t in ("trend", "ext", "volume", "absorb", "structure"))


@query(f"""WITH t AS ({SQL["technical_family"]}), v AS ({SQL["volume_family"]}), st AS ({SQL["structural_levels"]}) SELECT t.symbol, t.open_ms, {_status([(_ALL, "dependency_not_evaluated")], "pullback")}, {_when(_ALL, _PULLED, "pullback")} FROM t JOIN v ON t.symbol = v.symbol AND t.open_ms = v.open_ms JOIN st ON t.symbol = st.symbol AND t.open_ms = st.open_ms""")
def pullback_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend, extension, volume, flow and structure of each hourly bar side by side."""
    bars, key = hourly(spark, sf_dir), ["symbol", "open_ms"]
    traces = L.technical(bars, bar_side()).join(L.volume_family(bars, 2, bar_side()), key).join(_structure(spark, sf_dir), key)
    trace = L.pullback(bar_side(), *[F.col(c) for c in ("ema_trend", "atr_extension", "relative_volume", "absorption", "structure")])
    return flat(traces.select(*key, trace.alias("pullback")), key, {"pullback": "pullback"})


_N = "(volume_status = 'evaluated')::INT + (squeeze_status = 'evaluated')::INT + (absorb_status = 'evaluated')::INT"


@query(f"""WITH v AS ({SQL["volume_family"]}) SELECT symbol, {_N} AS evaluated, CASE {_N} WHEN 3 THEN 'evaluated' WHEN 0 THEN 'blocked' ELSE 'partially_evaluated' END AS state, count(*) AS bars FROM v GROUP BY ALL""")
def family_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many bars of each symbol have all, some or none of the volume rules."""
    state = L.family_state([F.col(c) for c in ("relative_volume", "compression", "absorption")])
    return L.volume_family(hourly(spark, sf_dir), 2, bar_side()).groupBy("symbol", state["evaluated"].alias("evaluated"), state["state"].alias("state")).agg(F.count("*").alias("bars"))
