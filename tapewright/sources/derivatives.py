"""A provider's answers as tables: books, tickers, funding, open interest and ratios.

All take rows (symbol, received_ms, body, error) as provider.read_answers gives them; rows with an error or an answer of another shape give no row, and
a field that is missing or no number is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels that a book can be asked for.
DEPTHS = (5, 10, 20, 50, 100, 500, 1000)
#: Fields of single answers, as column: (name, type).
QUOTE = {"bid": ("bidPrice", "double"), "bid_qty": ("bidQty", "double"), "ask": ("askPrice", "double"), "ask_qty": ("askQty", "double"), "at_ms": ("time", "long")}
DAY = {"last": ("lastPrice", "double"), "change_pct": ("priceChangePercent", "double"), "high": ("highPrice", "double"), "low": ("lowPrice", "double"), "volume": ("volume", "double"), "quote_volume": ("quoteVolume", "double")}
PREMIUM = {"mark": ("markPrice", "double"), "index": ("indexPrice", "double"), "funding_rate": ("lastFundingRate", "double"), "next_ms": ("nextFundingTime", "long"), "at_ms": ("time", "long")}
INTEREST = {"interest": ("openInterest", "double"), "at_ms": ("time", "long")}
#: Fields of series; the first is their time.
INTEREST_SERIES = {"at_ms": ("timestamp", "long"), "interest": ("sumOpenInterest", "double"), "worth": ("sumOpenInterestValue", "double")}
FUNDING_SERIES = {"at_ms": ("fundingTime", "long"), "rate": ("fundingRate", "double"), "mark": ("markPrice", "double")}
CROWD_SERIES = {"at_ms": ("timestamp", "long"), "ratio": ("longShortRatio", "double"), "long": ("longAccount", "double"), "short": ("shortAccount", "double")}
TAKER_SERIES = {"at_ms": ("timestamp", "long"), "ratio": ("buySellRatio", "double"), "buy": ("buyVol", "double"), "sell": ("sellVol", "double")}
MOOD_SERIES = {"at_s": ("timestamp", "long"), "value": ("value", "double")}


def nearest_depth(limit: int) -> int:
    """The number of levels that can be asked for nearest to a wish; of two as near the smaller."""
    return min(DEPTHS, key=lambda d: abs(d - min(max(limit, DEPTHS[0]), DEPTHS[-1])))


def _fields(item: Column, fields: dict[str, tuple[str, str]]) -> list[Column]:
    return [item[name].try_cast(kind).alias(c) for c, (name, kind) in fields.items()]


def single(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """symbol, received_ms and the fields of answers that are one object."""
    item = F.from_json("body", "map<string,string>")
    parsed = rows.where("error is null and body like '{%'").select("symbol", "received_ms", item.alias("o")).where("o is not null")
    return parsed.select("symbol", "received_ms", *_fields(F.col("o"), fields))


def series(rows: DataFrame, fields: dict[str, tuple[str, str]], within: str | None = None) -> DataFrame:
    """symbol and the fields of each item of answers that are lists (or hold one under the name within), one row for each time: of repeated ones the largest."""
    body = F.get_json_object("body", f"$.{within}") if within else F.col("body")
    items = rows.where("error is null").select("symbol", F.explode(F.from_json(body, "array<map<string,string>>")).alias("o")).where("o is not null")
    at, *others = fields
    known = items.select("symbol", *_fields(F.col("o"), fields)).where(F.col(at).isNotNull())
    if not others:
        return known.distinct()
    last = known.groupBy("symbol", at).agg(F.max(F.struct(*others)).alias("v"))
    return last.select("symbol", at, "v.*")


def latest(of: DataFrame, at: str = "at_ms") -> DataFrame:
    """The newest row of each symbol's series."""
    values = [c for c in of.columns if c != "symbol"]
    return of.groupBy("symbol").agg(F.max_by(F.struct(*values), at).alias("v")).select("symbol", "v.*")


def own_item(rows: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """The fields of the item that names the asked symbol, of answers that list several symbols, or of the one object."""
    listed = rows.where("error is null and body like '[%'").select("symbol", "received_ms", F.explode(F.from_json("body", "array<map<string,string>>")).alias("o"))
    mine = listed.where(F.upper(F.col("o")["symbol"]) == F.upper("symbol")).groupBy("symbol", "received_ms").agg(F.first("o").alias("o"))
    return single(rows, fields).unionByName(mine.select("symbol", "received_ms", *_fields(F.col("o"), fields)))


def book_levels(rows: DataFrame) -> DataFrame:
    """symbol, received_ms, bid, level (from 1), price, qty of the books in answers with bids and asks; levels without a price above 0 go."""
    sides = F.from_json("body", "struct<bids:array<array<string>>,asks:array<array<string>>>")
    books = rows.where("error is null").select("symbol", "received_ms", sides.alias("b"))
    out = None
    for name in ("bids", "asks"):
        own = books.select("symbol", "received_ms", F.lit(name == "bids").alias("bid"), F.posexplode(f"b.{name}").alias("i", "l"))
        own = own.select("symbol", "received_ms", "bid", (F.col("i") + 1).alias("level"), F.try_element_at("l", F.lit(1)).try_cast("double").alias("price"), F.try_element_at("l", F.lit(2)).try_cast("double").alias("qty"))
        out = own if out is None else out.unionByName(own)
    return out.where("price > 0 and qty is not null")
