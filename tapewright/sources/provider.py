"""Bars of an HTTP provider as a data source: pages of time are partitions, hosts stand in for each other."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, open_ms long, open double, high double, low double, close double, volume double, close_ms long, page_ms long, error string"
#: Bars that a page holds at most, and statuses that ask a client to wait.
PAGE, WAIT = 1500, (418, 429)
TEMPLATE = "/klines?symbol={symbol}&interval={interval}&limit={limit}&startTime={start}&endTime={end}"


@dataclass
class Page(InputPartition):
    symbol: str
    start: int
    end: int
    number: int


def bar_of(raw: object) -> tuple | None:
    """(open_ms, open, high, low, close, volume, close_ms) of a positional array; None if it is none."""
    try:
        return (int(raw[0]), *(float(x) for x in raw[1:6]), int(raw[6]))
    except (TypeError, ValueError, IndexError, KeyError):
        return None


class Hosts:
    """Answers of whatever host gives one. Hosts are tried in another order for each request, so load is spread; after all of them failed comes a wait."""

    def __init__(self, options: dict[str, str]) -> None:
        self.hosts = [h.rstrip("/") for h in options["hosts"].split(",") if h]
        self.timeout, self.rounds, self.backoff = float(options.get("timeout_s", 10)), int(options.get("rounds", 3)), float(options.get("backoff_s", 1))

    def get(self, path: str, number: int, kinds: tuple[type, ...]) -> object:
        """The answer to path, if it is of one of kinds; number shifts the order of hosts."""
        errors: list[str] = []
        for attempt in range(self.rounds):
            wait = self.backoff * 2**attempt
            for i in range(len(self.hosts)):
                host = self.hosts[(number + i) % len(self.hosts)]
                try:
                    with urllib.request.urlopen(urllib.request.Request(host + path, headers={"Accept": "application/json"}), timeout=self.timeout) as answer:
                        found = json.loads(answer.read().decode("utf-8"))
                    if isinstance(found, kinds):
                        return found
                    errors.append(f"{host}: another kind of answer")
                except urllib.error.HTTPError as e:
                    errors.append(f"{host}: HTTP {e.code}")
                    asked = e.headers.get("Retry-After", "")
                    if e.code in WAIT and asked.isdigit():
                        wait = min(max(wait, float(asked)), self.backoff * 2**self.rounds)
                except (OSError, ValueError) as e:
                    errors.append(f"{host}: {type(e).__name__}")
            if attempt + 1 < self.rounds:
                time.sleep(wait)
        raise RuntimeError(f"no host gave {path}: " + " | ".join(errors[-len(self.hosts) :]))


class Reader(DataSourceReader):
    """Options: hosts and symbols (comma separated), interval, interval_ms, start_ms, end_ms; limit (1500), timeout_s (10), rounds (3: how often all hosts are
    tried), backoff_s (1, doubled each round; the longest wait a host may ask for), mode (permissive or failfast), template."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.limit = min(PAGE, int(options.get("limit", PAGE)))

    def partitions(self) -> list[Page]:
        o = self.options
        step = int(o["interval_ms"])
        start, end, width = int(o["start_ms"]) // step * step, int(o["end_ms"]), step * self.limit
        pages = [(s, at) for s in o["symbols"].split(",") if s for at in range(start, end + 1, width)]
        return [Page(s, max(at, int(o["start_ms"])), min(at + width - 1, end), i) for i, (s, at) in enumerate(pages)]

    def fetch(self, page: Page) -> list:
        path = self.options.get("template", TEMPLATE).format(symbol=urllib.parse.quote(page.symbol.upper()), interval=self.options["interval"], limit=self.limit, start=page.start, end=page.end)
        return Hosts(self.options).get(path, page.number, (list,))

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            found = self.fetch(partition)
        except RuntimeError as e:
            if self.options.get("mode", "permissive") == "failfast":
                raise
            yield (partition.symbol, *[None] * 7, partition.start, str(e))
            return
        for raw in found:
            bar = bar_of(raw)
            if bar and partition.start <= bar[0] <= partition.end:
                yield (partition.symbol, *bar, partition.start, None)


class AnswerReader(DataSourceReader):
    """One answer for each symbol, as text. Options as of klines, but template (with {symbol}) and no pages."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[Page]:
        return [Page(s, 0, 0, i) for i, s in enumerate(x for x in self.options["symbols"].split(",") if x)]

    def read(self, partition: Page) -> Iterator[tuple]:
        path = self.options["template"].format(symbol=urllib.parse.quote(partition.symbol.upper()))
        try:
            found = Hosts(self.options).get(path, partition.number, (list, dict))
        except RuntimeError as e:
            if self.options.get("mode", "permissive") == "failfast":
                raise
            yield partition.symbol, None, None, str(e)
            return
        yield partition.symbol, int(time.time() * 1000), json.dumps(found), None


class AnswerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "answers"

    def schema(self) -> str:
        return "symbol string, received_ms long, body string, error string"

    def reader(self, schema: object) -> AnswerReader:
        return AnswerReader(self.options)


class KlineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> Reader:
        return Reader(self.options)


def read_provider(spark: SparkSession, **options: object) -> DataFrame:
    """Rows of the provider as they come; a page that no host gave is one row with an error (mode permissive)."""
    spark.dataSource.register(KlineSource)
    return spark.read.format("klines").options(**{k: str(v) for k, v in options.items()}).load()


def provider_bars(rows: DataFrame) -> DataFrame:
    """One bar for each symbol and open; of repeated ones the one that closes last, then the largest."""
    values = ("close_ms", "open", "high", "low", "close", "volume")
    last = rows.where("error is null").groupBy("symbol", "open_ms").agg(F.max(F.struct(*values)).alias("b"))
    return last.select("symbol", "open_ms", *[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume", "close_ms")])


def missing_pages(rows: DataFrame) -> DataFrame:
    """The pages that no host gave, to be asked for again."""
    return rows.where("error is not null").select("symbol", "page_ms", "error")


def read_answers(spark: SparkSession, **options: object) -> DataFrame:
    """symbol, received_ms, body and error: what a provider says of each symbol; no answer is a row with an error (mode permissive)."""
    spark.dataSource.register(AnswerSource)
    return spark.read.format("answers").options(**{k: str(v) for k, v in options.items()}).load()
