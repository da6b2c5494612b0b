"""Operations that lapse by timers, the append-only store of snapshots, and the provider's pages with failing hosts."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tapewright.sources import derivatives, provider, snapshots
from tapewright.streaming import lifecycle

TICK = "operation_id long, ts_ms long, price double, side string, trigger_price double, stop double, target double, expires_ms long"
MINUTE = 60_000


def test_operations_lapse_without_a_tick(spark, tmp_path):
    def tick(i, at, price, side="long", expires=10 * MINUTE):
        levels = (100.0, 95.0, 110.0) if side == "long" else (100.0, 105.0, 90.0)
        return (i, at, price, side, *levels, expires)

    batches = [
        [tick(1, 1, 101.0), tick(2, 1, 99.0), tick(3, 1, 99.0, "short"), tick(4, 1, 100.0, "short"), tick(4, 2, 106.0, "short")],
        [tick(9, 60 * MINUTE, 101.0, expires=90 * MINUTE)],  # moves the watermark past the others' expiry
        [tick(9, 61 * MINUTE, 101.0, expires=90 * MINUTE), tick(1, 61 * MINUTE, 99.0)],
    ]
    source = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, TICK).coalesce(1).write.json(str(tmp_path / f"b{i}"))
    source.mkdir()
    stream = lifecycle.stream_operations(spark.readStream.schema(TICK).json(str(source)))
    progress = []
    for i in range(len(batches)):
        for part in (tmp_path / f"b{i}").glob("part-*"):
            part.rename(source / f"{i}-{part.name}")
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        progress += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = sorted((r["operation_id"], r["event"], r["status"], r["at_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # 1 rested and lapsed, 2 opened and ended at its expiry, 4 was stopped out; none of them had a tick at that time
    assert got == [(1, "expire", "EXPIRED_UNFILLED", 10 * MINUTE), (2, "expire", "CLOSED", 10 * MINUTE), (2, "trigger", "OPEN", 1), (3, "expire", "EXPIRED_UNFILLED", 10 * MINUTE), (4, "stop_loss", "CLOSED", 2), (4, "trigger", "OPEN", 1)]
    assert max(progress) >= 4 and progress[-1] == 1  # only the living operation's state is left


# ---- snapshots


def record(seq, op, kind, payload, day="2026-08-05", **other):
    said = payload if isinstance(payload, str) else json.dumps(payload, sort_keys=True)
    row = {"seq": seq, "operation_id": op, "snapshot_type": kind, "event_at": dt.datetime.fromisoformat(f"{day}T10:00:00"), "payload": said, "payload_bytes": len(said.encode()), "payload_sha256": hashlib.sha256(said.encode()).hexdigest(), "case_day": dt.date.fromisoformat(day) if kind == "placement" else None}
    return {**row, **other}


BATCH = "seq long, operation_id long, snapshot_type string, event_at timestamp, payload string, payload_bytes long, payload_sha256 string, case_day date"


def commit(spark, path, rows):
    return {r["seq"]: (r["status"], r["daily_slot"]) for r in snapshots.append_snapshots(spark.createDataFrame(rows, BATCH).repartition(3), path).collect()}


def test_snapshots_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [record(1, 10, "activation", {"a": 1}), record(2, 10, "placement", {"a": 1}), record(3, 10, "activation", {"a": 1}), record(4, 10, "placement", {"a": 1}), record(5, 10, "placement", {"a": 2}), record(6, 11, "placement", {"é": 1}), record(7, 12, "closure", {})]
    # the first activation comes too early; its key's later row does not change that within the batch
    first = commit(spark, path, rows)
    assert first == {1: ("placement_snapshot_required", None), 2: ("recorded", 1), 3: ("placement_snapshot_required", None), 4: ("idempotent_skip", 1), 5: ("snapshot_conflict_existing_payload", None), 6: ("recorded", 2), 7: ("placement_snapshot_required", None)}
    # replayed: what is there is skipped, nothing is written twice
    again = commit(spark, path, rows)
    assert [again[i] for i in (2, 4, 5, 6)] == [("idempotent_skip", 1), ("idempotent_skip", 1), ("snapshot_conflict_existing_payload", None), ("idempotent_skip", 2)]
    assert again[1] == ("recorded", None) and again[3] == ("idempotent_skip", None)  # now the placement is there
    before = snapshots.read_snapshots(spark, path).count()
    commit(spark, path, rows)
    assert snapshots.read_snapshots(spark, path).count() == before == 3


def test_a_day_has_fifty_slots(spark, tmp_path):
    path = str(tmp_path / "table")
    commit(spark, path, [record(i, i, "placement", {"i": i}) for i in range(30)])
    got = commit(spark, path, [record(i, 100 + i, "placement", {"i": i}) for i in range(21)] + [record(90, 200, "placement", {}, "2026-08-06"), record(91, 120, "closure", {})])
    assert [got[i][1] for i in range(20)] == list(range(31, 51)) and got[20] == ("daily_selected_case_cap_reached", None)
    assert got[90] == ("recorded", 1) and got[91] == ("placement_snapshot_required", None)


def test_odd_snapshots_are_refused(spark, tmp_path):
    big = {"x": "y" * 4000}
    rows = [
        record(1, 1, "other", {}),
        record(2, 2, "placement", "[1]"),
        record(3, 3, "placement", "{broken"),
        record(4, 4, "placement", {}, payload_bytes=1),
        record(5, 5, "placement", big),
        record(6, 6, "placement", {}, payload_sha256="0"),
        record(7, 7, "placement", {}, case_day=dt.date(2020, 1, 1)),
        record(8, 8, "closure", {}, case_day=dt.date(2026, 8, 5)),
        record(9, None, "placement", {}),
    ]
    got = commit(spark, str(tmp_path / "t"), rows)
    assert [got[i][0] for i in range(1, 10)] == ["invalid_snapshot_type", "payload_json_invalid", "payload_json_invalid", "payload_byte_count_mismatch", "snapshot_payload_budget_exceeded", "snapshot_payload_hash_mismatch", "selected_case_day_mismatch", "selected_case_day_only_for_placement", "snapshot_record_fields_missing"]
    assert snapshots.read_snapshots(spark, str(tmp_path / "t")).count() == 0
    sizes = spark.createDataFrame([(50, 365), (51, 1), (0, 1)], "c long, d long").select(snapshots.projected_bytes(F.col("c"), F.col("d")).alias("b")).collect()
    assert [r["b"] for r in sizes] == [107_456_000, None, None]


def test_snapshots_of_a_stream(spark, tmp_path):
    spark.createDataFrame([record(1, 1, "placement", {}), record(2, 1, "closure", {})], BATCH).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(BATCH).parquet(str(tmp_path / "in"))
    for checkpoint in ("cp", "another"):  # the second one replays the batch
        snapshots.snapshot_stream(stream, str(tmp_path / "t"), str(tmp_path / checkpoint), lambda df, i: seen.append(sorted(r["status"] for r in df.collect()))).awaitTermination(120)
    assert seen == [["recorded", "recorded"], ["idempotent_skip", "idempotent_skip"]] and snapshots.read_snapshots(spark, str(tmp_path / "t")).count() == 2


# ---- provider


class Provider(BaseHTTPRequestHandler):
    calls: list[tuple[str, int]] = []

    def do_GET(self):
        asked = parse_qs(urlparse(self.path).query)
        symbol, start, end, limit = asked["symbol"][0], *(int(asked[k][0]) for k in ("startTime", "endTime", "limit"))
        kind = self.server.kind
        Provider.calls.append((kind, start))
        if kind == "down" or kind == "busy" or symbol == "NONE":
            self.send_response(429 if kind == "busy" else 500)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        bars = [[t, "1", "2", "0.5", str(t % 7), "3", t + 59_999] for t in range(-(-start // 60_000) * 60_000, end + 1, 60_000) if t % 540_000][:limit]  # some minutes are missing
        body = json.dumps([*bars, *bars[:2], ["odd"], None, [10**15, "1", "1", "1", "1", "1", 10**15]]).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def hosts():
    servers = []
    for kind in ("down", "busy", "good"):
        s = ThreadingHTTPServer(("127.0.0.1", 0), Provider)
        s.kind = kind
        threading.Thread(target=s.serve_forever, daemon=True).start()
        servers.append(s)
    yield [f"http://127.0.0.1:{s.server_port}" for s in servers]
    for s in servers:
        s.shutdown()


def test_pages_come_from_whatever_host_answers(spark, hosts):
    options = {"hosts": ",".join(hosts), "symbols": "aa,NONE", "interval": "1m", "interval_ms": 60_000, "start_ms": 60_000, "end_ms": 60 * 60_000, "limit": 10, "rounds": 2, "backoff_s": 0.01}
    rows = provider.read_provider(spark, **options)
    assert rows.rdd.getNumPartitions() == 2 * 6
    found = rows.collect()
    bars = provider.provider_bars(spark.createDataFrame(found, rows.schema)).orderBy("open_ms").collect()
    want = [t * 60_000 for t in range(1, 61) if t % 9]
    assert [r["open_ms"] for r in bars] == want and {r["symbol"] for r in bars} == {"aa"} and bars[0]["close_ms"] == want[0] + 59_999
    assert provider.missing_pages(spark.createDataFrame(found, rows.schema)).count() == 6  # of the symbol that no host has
    with pytest.raises(Exception, match="no host gave"):
        provider.read_provider(spark, **{**options, "hosts": hosts[0], "mode": "failfast", "rounds": 1}).collect()


ANSWERS = {
    "/depth": {"bids": [["99.5", "2"], ["99", "1"], ["odd", "1"], []], "asks": [["100.5", "3"]], "E": 1},
    "/quote": {"bidPrice": "99.5", "bidQty": "2", "askPrice": "100.5", "askQty": "x", "time": 7},
    "/funding": [{"fundingTime": 8, "fundingRate": "0.0001", "markPrice": ""}, {"fundingTime": 16, "fundingRate": "0.0002"}, {"fundingTime": 16, "fundingRate": "0.0002"}, None, {"fundingRate": "1"}],
    "/info": [{"symbol": "BB", "fundingIntervalHours": 4}, {"symbol": "AA", "fundingIntervalHours": 8}],
    "/mood": {"data": [{"timestamp": "3", "value": "40"}, {"timestamp": "2", "value": "30"}]},
}


class Answers(BaseHTTPRequestHandler):
    def do_GET(self):
        path = urlparse(self.path)
        missing = parse_qs(path.query)["symbol"][0] == "NONE"
        self.send_response(404 if missing else 200)
        self.end_headers()
        if not missing:
            self.wfile.write(json.dumps(ANSWERS[path.path]).encode())

    def log_message(self, *args):
        pass


def test_answers_become_tables(spark):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def asked(path):
        rows = provider.read_answers(spark, hosts=f"http://127.0.0.1:{server.server_port}", symbols="aa,NONE", template=path + "?symbol={symbol}", rounds=1)
        found = rows.collect()
        assert [r["symbol"] for r in found if r["error"]] == ["NONE"]
        return spark.createDataFrame(found, rows.schema)

    D = derivatives
    levels = sorted((r["bid"], r["level"], r["price"], r["qty"]) for r in D.book_levels(asked("/depth")).collect())
    assert levels == [(False, 1, 100.5, 3.0), (True, 1, 99.5, 2.0), (True, 2, 99.0, 1.0)]
    quote = D.single(asked("/quote"), D.QUOTE).collect()
    assert [(r["symbol"], r["bid"], r["ask"], r["ask_qty"], r["at_ms"]) for r in quote] == [("aa", 99.5, 100.5, None, 7)]
    funding = D.series(asked("/funding"), D.FUNDING_SERIES)
    assert sorted((r["at_ms"], r["rate"], r["mark"]) for r in funding.collect()) == [(8, 0.0001, None), (16, 0.0002, None)]
    assert [(r["at_ms"], r["rate"]) for r in D.latest(funding).collect()] == [(16, 0.0002)]
    info = {"hours": ("fundingIntervalHours", "long")}
    assert [(r["symbol"], r["hours"]) for r in D.own_item(asked("/info"), info).collect()] == [("aa", 8)]
    assert sorted((r["at_s"], r["value"]) for r in D.series(asked("/mood"), D.MOOD_SERIES, "data").collect()) == [(2, 30.0), (3, 40.0)]
    assert D.single(asked("/info"), D.QUOTE).count() == 0 and D.series(asked("/quote"), D.FUNDING_SERIES).count() == 0
    assert [D.nearest_depth(x) for x in (1, 7, 8, 30, 60, 9999)] == [5, 5, 10, 20, 50, 1000]
    server.shutdown()
