"""Streams of prices and the life of resting and open operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "operation_id long, status string, event string, at_ms long, price double"
_STATE = "status string, expires_ms long, price double"


def stream_bars(trades: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream of trades (symbol, ts, trade_id, price, qty); a bar is final once the watermark passes its end."""
    return (
        trades.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", size))
        .agg(F.min_by("price", F.struct("ts", "trade_id")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", F.struct("ts", "trade_id")).alias("close"), F.sum("qty").alias("volume"))
        .select("symbol", F.col("window.start").alias("open_time"), "open", "high", "low", "close", "volume")
    )


def stream_latest(ticks: DataFrame) -> DataFrame:
    """The newest price of each symbol; late ticks never replace newer ones."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("price", "ts_ms"), F.struct("ts_ms", "price")).alias("v")).select("symbol", "v.*")


def fresh_prices(latest: DataFrame, now_ms: int, within_ms: int) -> DataFrame:
    """Prices with their age and whether they are young enough to act on."""
    age = F.lit(now_ms) - F.col("ts_ms")
    return latest.withColumn("age_ms", age).withColumn("fresh", (age >= 0) & (age <= within_ms))


def moving(rows: pd.DataFrame) -> pd.Series:
    """Which ticks can move an operation at all: those that touch one of its levels or come at its expiry."""
    long, p = rows["side"] == "long", rows["price"]
    down = (p <= rows["stop"]) | (p <= rows["trigger_price"]) | (p >= rows["target"])
    up = (p >= rows["stop"]) | (p >= rows["trigger_price"]) | (p <= rows["target"])
    return (long & down) | (~long & up) | (rows["ts_ms"] >= rows["expires_ms"])


def stream_operations(ticks: DataFrame, late: str = "1 minute") -> DataFrame:
    """Transitions of operations, from a stream of their own ticks.

    ticks: operation_id, ts_ms, price, side, trigger_price, stop, target, expires_ms. A resting operation opens when its trigger is
    touched and lapses at its expiry; an open one closes at its stop (which comes first), target or expiry. The state, a status, the expiry and the last price
    of an operation, lives until the watermark (late behind the newest tick) passes its expiry: a timer then ends an operation that is still alive, even
    if no tick comes, and the state is gone. A closed one's later ticks are ignored till then, and so are ticks of an operation whose expiry the watermark has passed. Ticks that cannot move
    an operation are not held.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, expires, price = state.get if state.exists else ("PENDING_ENTRY", None, None)
        out: list[tuple] = []

        def ended() -> bool:
            return status not in ("PENDING_ENTRY", "OPEN")

        def move(event: str, at: int, paid: float) -> None:
            nonlocal status
            status = {"trigger": "OPEN", "expire": "EXPIRED_UNFILLED" if status == "PENDING_ENTRY" else "CLOSED"}.get(event, "CLOSED")
            out.append((key[0], status, event, at, paid))

        if state.hasTimedOut:
            if not ended():
                move("expire", expires, price)
            state.remove()
            yield pd.DataFrame(out, columns=["operation_id", "status", "event", "at_ms", "price"])
            return
        held, latest, fresh = [], None, not state.exists
        for rows in batches:
            expires = max(int(rows["expires_ms"].max()), expires or 0)
            newest = rows.loc[rows["ts_ms"].idxmax()]
            latest = newest if latest is None or newest["ts_ms"] > latest["ts_ms"] else latest
            held.append(rows[moving(rows)])
        price, passed = float(latest["price"]), state.getCurrentWatermarkMs()
        if fresh and expires <= passed:  # ended before; its state is gone already
            yield pd.DataFrame(out, columns=["operation_id", "status", "event", "at_ms", "price"])
            return
        for r in pd.concat(held).sort_values("ts_ms", kind="stable").itertuples(index=False):
            if ended():
                break
            long = r.side == "long"
            if r.ts_ms >= r.expires_ms:
                move("expire", r.ts_ms, r.price)
            elif status == "PENDING_ENTRY":
                if r.price <= r.trigger_price if long else r.price >= r.trigger_price:
                    move("trigger", r.ts_ms, r.price)
            elif r.price <= r.stop if long else r.price >= r.stop:
                move("stop_loss", r.ts_ms, r.price)
            elif r.price >= r.target if long else r.price <= r.target:
                move("take_profit", r.ts_ms, r.price)
        if expires > passed:
            state.update((status, expires, price))
            state.setTimeoutTimestamp(expires)
        else:  # the timer's time is over already
            if not ended():
                move("expire", expires, price)
            if state.exists:
                state.remove()
        yield pd.DataFrame(out, columns=["operation_id", "status", "event", "at_ms", "price"])

    timed = ticks.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", late)
    return timed.groupBy("operation_id").applyInPandasWithState(step, OUTPUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
