"""Scalar expressions on columns; all stay inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: How a close reason reads in a report.
CLOSURE_TYPES = {
    "take_profit": "automatic_take_profit",
    "stop_loss": "automatic_stop_loss",
    "manual": "manual",
    "time_expired": "time_expired",
    "contest_expired": "contest_expired",
}
#: How a plan's result counts economically.
PLAN_OUTCOMES = {
    "plan_success": "take_profit",
    "plan_failure": "stop_loss",
    "ambiguous_same_candle": "ambiguous",
    "expired_mark_to_market": "mark_to_market",
    "unresolved": "unresolved",
}


def safe_double(value: Column) -> Column:
    """A finite double, or null."""
    x = value.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def parse_iso(text: Column) -> Column:
    """An ISO-8601 timestamp; without an offset it is UTC, what cannot be read is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def bucket_start(ms: Column, size_ms: int) -> Column:
    """Start of the tumbling bucket that holds a time in milliseconds."""
    return ms - F.pmod(ms, F.lit(size_ms))


def archive_millis(stamp: Column) -> Column:
    """Epoch stamps of archives come in micro- or milliseconds; the size tells which."""
    return F.when(stamp > 10**15, F.floor(stamp / 1000)).otherwise(stamp).cast("long")


def expected_minutes(start_ms: Column, end_ms: Column) -> Column:
    """Number of minute bars that touch a closed range of milliseconds."""
    return F.floor(end_ms / MINUTE_MS) - F.floor(start_ms / MINUTE_MS) + 1


def evidence_quality(start_ms: Column, end_ms: Column, found: Column) -> Column:
    """complete_1m, complete_1m_with_boundaries, or partial_1m below 98 % coverage; unavailable without bars."""
    wanted = expected_minutes(start_ms, end_ms)
    aligned = (F.pmod(start_ms, F.lit(MINUTE_MS)) == 0) & (F.pmod(end_ms + 1, F.lit(MINUTE_MS)) == 0)
    return F.when(found == 0, "unavailable").when(found / wanted < 0.98, "partial_1m").when(aligned, "complete_1m").otherwise("complete_1m_with_boundaries")


def lookup(value: Column, names: dict[str, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[value], F.lit(other))


def closure_type(reason: Column) -> Column:
    return lookup(reason, CLOSURE_TYPES, "other")


def plan_outcome(result: Column) -> Column:
    return lookup(result, PLAN_OUTCOMES, "not_available")


def week_cluster(ms: Column) -> Column:
    """First day of the ISO week."""
    return F.to_date(F.date_trunc("week", F.timestamp_millis(ms)))


def valid_plan(side: Column, entry: Column, stop: Column, target: Column) -> Column:
    """Whether a plan's levels lie on the right sides of its entry."""
    return F.when(side == "long", (stop < entry) & (entry < target)).when(side == "short", (target < entry) & (entry < stop)).otherwise(F.lit(False))


def entry_trigger(side: Column) -> Column:
    """The condition that fills a resting entry order."""
    return F.when(side == "long", "price_lte").when(side == "short", "price_gte")


def entry_touched(condition: Column, low: Column, high: Column) -> Column:
    return F.when(condition == "price_gte", high >= F.col("trigger_price")).when(condition == "price_lte", low <= F.col("trigger_price")).otherwise(F.lit(False))


def log_distances(side: Column, entry: Column, stop: Column, target: Column) -> tuple[Column, Column]:
    """Logarithmic distances from the entry to the target and to the stop; positive for a valid plan."""
    up = F.when(side == "long", F.ln(target / entry)).otherwise(F.ln(entry / target))
    down = F.when(side == "long", F.ln(entry / stop)).otherwise(F.ln(stop / entry))
    return up, down


def bar_hits(side: Column, low: Column, high: Column, stop: Column, target: Column) -> tuple[Column, Column]:
    """Whether a bar's range touches the stop, and the target."""
    long = side == "long"
    return F.when(long, low <= stop).otherwise(high >= stop), F.when(long, high >= target).otherwise(low <= target)


def live_exit(side: Column, low: Column, high: Column, stop: Column, target: Column) -> Column:
    """The exit that a live position takes on a bar; where both levels are touched the stop comes first."""
    at_stop, at_target = bar_hits(side, low, high, stop, target)
    return F.when(at_stop, "stop_loss").when(at_target, "take_profit")


#: The transitions of a resting order's life.
TRANSITIONS = {
    ("PENDING_ENTRY", "trigger"): "OPEN",
    ("PENDING_ENTRY", "expire"): "EXPIRED_UNFILLED",
    ("PENDING_ENTRY", "cancel"): "CANCELLED",
    ("OPEN", "take_profit"): "CLOSED",
    ("OPEN", "stop_loss"): "CLOSED",
    ("OPEN", "expire"): "CLOSED",
    ("OPEN", "manual"): "CLOSED",
}


def transition(status: Column, event: Column) -> Column:
    """The status after an event; null where the event is not allowed."""
    table = F.create_map(*[F.lit(x) for (a, b), c in TRANSITIONS.items() for x in (f"{a}/{b}", c)])
    return table[F.concat_ws("/", status, event)]


# ---- times and texts


def iso_of_millis(ms: Column) -> Column:
    """ISO-8601 text in UTC; the session's time zone is expected to be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def minutes_between(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 60_000_000, 2)


def month_season(at: Column) -> Column:
    """Code, first day and first day of the next month of a contest's season."""
    first = F.trunc(at, "month")
    return F.struct(F.date_format(at, "yyyy-MM").alias("code"), first.alias("starts"), F.add_months(first, 1).alias("ends"))


def note_stamp(note: Column) -> Column:
    """The time that a closing note names after the word vela; null without one that can be read."""
    return parse_iso(F.nullif(F.regexp_extract(note, r"vela (\S+)", 1), F.lit("")))


def ban_until(text: Column) -> Column:
    """The epoch milliseconds that a ban message names."""
    return F.nullif(F.regexp_extract(text, r"banned until (\d+)", 1), F.lit("")).cast("long")


def level_name(ratio: Column) -> Column:
    """A ratio with three decimals at most and no trailing zeros."""
    return F.regexp_replace(F.format_string("%.3f", ratio), r"\.?0+$", "")


def sampling_interval(horizon_s: Column, intervals: tuple[int, ...], least: int = 24) -> Column:
    """The largest interval that divides a horizon into at least so many bars."""
    fits = F.filter(F.array(*map(F.lit, intervals)), lambda i: (horizon_s % i == 0) & (horizon_s >= i * least))
    return F.array_max(fits)


def order_type(side: Column, trigger: Column) -> Column:
    """Market without a trigger; a trigger that waits for a better price is a pullback, others follow a break."""
    better = ((side == "long") & (trigger == "price_lte")) | ((side == "short") & (trigger == "price_gte"))
    return F.when(trigger.isNull(), "market").when(better, "limit_pullback").when(side == "long", "stop_breakout").otherwise("stop_breakdown")


def relative(a: Column, b: Column) -> Column:
    """a in percent of b; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b * 100)


# ---- JSON


def json_field(raw: Column, path: str) -> Column:
    """The text at a path of a JSON text; null where the text cannot be read or has nothing there."""
    return F.get_json_object(raw, path)


def preferred_number(raw: Column, path: str, other: Column) -> Column:
    """A finite number at a path of a JSON text, else another column."""
    return F.coalesce(safe_double(json_field(raw, path)), other)


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def payload_digest(fields: dict[str, Column]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def flat_numbers(raw: Column, paths: list[str]) -> Column:
    """A map of the numbers at dotted paths of a JSON text; what is no number, or no finite one, has no entry."""
    entries = F.array(*[F.struct(F.lit(p).alias("key"), F.get_json_object(raw, f"$.{p}").try_cast("double").alias("value")) for p in paths])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull() & (F.abs(e["value"]) < float("inf"))))


def image_type(content: Column) -> Column:
    """The kind of an image by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
