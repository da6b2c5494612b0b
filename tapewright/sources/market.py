"""Sources of market data: archives of bars, kline arrays, JSON lines, and the event table as trades."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.functions.scalars import archive_millis

BAR_SCHEMA = "symbol string, open_ms long, open double, high double, low double, close double, volume double, close_ms long"


def trades_of_events(events: DataFrame) -> DataFrame:
    """The event table as trades: a symbol for each type, a price above 100 from the value, a quantity and a side from the id."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts_ms"),
        F.col("event_id").alias("trade_id"),
        "user_id",
        (F.col("value") + 100).alias("price"),
        (F.col("event_id") % 7 + 1).cast("double").alias("qty"),
        (F.col("event_id") % 2 == 1).alias("maker"),
    )


def read_klines(spark: SparkSession, path: str) -> DataFrame:
    """Bars of JSON lines that hold a symbol and a positional kline array; malformed rows go, the last of a repeated open stays.

    Last is the row furthest on in the file whose name is the largest.
    """
    raw = spark.read.schema("symbol string, kline array<string>").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    at = lambda i: F.try_element_at("kline", F.lit(i + 1))
    rows = raw.select("symbol", "file", F.struct("block", "row").alias("place"), at(0).try_cast("long").alias("open_ms"), *[at(i + 1).try_cast("double").alias(n) for i, n in enumerate(("open", "high", "low", "close", "volume"))], at(6).try_cast("long").alias("close_ms"))
    order = F.struct("file", "place")
    rows = rows.dropna(subset=[c for c in rows.columns if c not in ("file", "place")])
    last = rows.groupBy("symbol", "open_ms").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "close_ms"), order).alias("b"))
    return last.select("symbol", "open_ms", "b.*")


def read_zip_archives(spark: SparkSession, path: str) -> DataFrame:
    """Bars of monthly ZIP archives of CSV files named SYMBOL-...; micro- or millisecond stamps, headers skipped, the last file wins."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                file = name.rsplit("/", 1)[-1]
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        with io.TextIOWrapper(archive.open(member), "utf-8", newline="") as text:
                            rows = [r[:7] for r in csv.reader(text) if len(r) >= 7 and r[0].isdigit()]
                        columns = [pa.array([file.split("-")[0]] * len(rows)), pa.array([file] * len(rows)), *(pa.array([r[i] for r in rows], pa.string()) for i in range(7))]
                        yield pa.RecordBatch.from_arrays(columns, ["symbol", "file", *(f"c{i}" for i in range(7))])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    rows = files.mapInArrow(unpack, "symbol string, file string, " + ", ".join(f"c{i} string" for i in range(7)))
    typed = rows.select("symbol", "file", archive_millis(F.col("c0").cast("long")).alias("open_ms"), *[F.col(f"c{i}").cast("double").alias(n) for i, n in zip(range(1, 6), ("open", "high", "low", "close", "volume"), strict=True)], archive_millis(F.col("c6").cast("long")).alias("close_ms"))
    last = typed.groupBy("symbol", "open_ms").agg(F.max_by(F.struct("open", "high", "low", "close", "volume", "close_ms"), "file").alias("b"))
    return last.select("symbol", "open_ms", "b.*")


def month_grid(spark: SparkSession, symbols: list[str], start: str, end: str) -> DataFrame:
    """The archive names of some symbols from one month to another."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.explode(F.array(*map(F.lit, symbols))).alias("symbol")).select("symbol", "month", F.concat_ws("-", "symbol", F.date_format("month", "yyyy-MM")).alias("archive"))
