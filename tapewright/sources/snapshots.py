"""An append-only table of snapshots: no row is ever changed, a batch can be committed again, and days and payloads have budgets.

A snapshot's key is its operation and type. Of a batch each row gets a status: recorded; idempotent_skip (the same payload is there);
snapshot_conflict_existing_payload (another one is); placement_snapshot_required (an operation's first snapshot has to be its placement);
daily_selected_case_cap_reached (a day's slots are taken); or what is wrong with the row itself. Rows of a batch are judged in the order of seq, as if
they came one by one. A Spark write is committed as a whole, so a batch that failed half way leaves nothing, and its repetition
finds either all of its rows or none. One stream writes a table at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from tapewright.storage import stored

#: Bytes that a payload of each type may have, and placements of a day.
BUDGETS = {"placement": 3584, "activation": 1280, "closure": 1024}
SLOTS = 50
COLUMNS = "operation_id long, snapshot_type string, event_at timestamp, payload string, payload_bytes long, payload_sha256 string, case_day date, daily_slot int"


def projected_bytes(cases_a_day: Column, days: Column) -> Column:
    """Bytes that so many cases a day take up over so many days; null beyond a day's slots or for no case or day."""
    good = (cases_a_day > 0) & (days > 0) & (cases_a_day <= SLOTS)
    return F.when(good, cases_a_day * days * sum(BUDGETS.values()))


def problem() -> Column:
    """What is wrong with a row itself, or null."""
    size = F.octet_length("payload")
    budget = F.create_map(*[F.lit(x) for kv in BUDGETS.items() for x in kv])[F.col("snapshot_type")]
    day = F.to_date("event_at")
    return (
        F.when(F.col("operation_id").isNull() | F.col("event_at").isNull() | F.col("payload").isNull(), "snapshot_record_fields_missing")
        .when(~F.coalesce(F.col("snapshot_type").isin(*BUDGETS), F.lit(False)), "invalid_snapshot_type")
        .when(~F.coalesce(F.schema_of_variant(F.try_parse_json("payload")).startswith("OBJECT"), F.lit(False)), "payload_json_invalid")
        .when(~F.col("payload_bytes").eqNullSafe(size), "payload_byte_count_mismatch")
        .when(size > budget, "snapshot_payload_budget_exceeded")
        .when(~F.col("payload_sha256").eqNullSafe(F.sha2("payload", 256)), "snapshot_payload_hash_mismatch")
        .when((F.col("snapshot_type") == "placement") & ~F.col("case_day").eqNullSafe(day), "selected_case_day_mismatch")
        .when((F.col("snapshot_type") != "placement") & F.col("case_day").isNotNull(), "selected_case_day_only_for_placement")
    )


def read_snapshots(spark: object, path: str) -> DataFrame:
    try:
        return spark.read.schema(COLUMNS).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], COLUMNS)  # not written yet


def judged(batch: DataFrame, known: DataFrame) -> DataFrame:
    """batch (seq and the table's columns but daily_slot) with status and daily_slot, against the table known."""
    key = ["operation_id", "snapshot_type"]
    rows = batch.withColumn("status", problem())
    there = known.select(*key, F.col("payload_sha256").alias("there"), F.col("daily_slot").alias("there_slot"))
    rows = rows.join(there, key, "left")
    same = F.when(F.col("payload_sha256") == F.col("there"), "idempotent_skip").otherwise("snapshot_conflict_existing_payload")
    rows = rows.withColumn("status", F.coalesce("status", F.when(F.col("there").isNotNull(), same)))
    # of new rows with one key the first stands for all
    fresh = F.col("status").isNull()
    own = Window.partitionBy(*key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(fresh, F.struct("seq", "payload_sha256")), ignorenulls=True).over(own)
    rows = rows.withColumn("first", first).withColumn("leads", fresh & (F.col("seq") == F.col("first.seq")))
    used = known.where("snapshot_type = 'placement'").groupBy("case_day").agg(F.max("daily_slot").alias("used"))
    asks = rows.where("leads and snapshot_type = 'placement'").select("operation_id", "case_day", "seq")
    slot = F.row_number().over(Window.partitionBy("case_day").orderBy("seq")) + F.coalesce("used", F.lit(0))
    placed = asks.join(used, "case_day", "left").select("operation_id", F.col("seq").alias("placed_seq"), slot.cast("int").alias("slot"))
    before = known.where("snapshot_type = 'placement'").select(F.col("operation_id"), F.lit(True).alias("placed"))
    rows = rows.join(placed, "operation_id", "left").join(before, "operation_id", "left")
    fits = F.coalesce(F.col("slot") <= SLOTS, F.lit(False))
    ready = F.coalesce("placed", F.lit(False)) | fits & (F.col("placed_seq") < F.col("seq"))
    leader = F.when(F.col("snapshot_type") == "placement", F.when(fits, "recorded").otherwise("daily_selected_case_cap_reached")).otherwise(F.when(ready, "recorded").otherwise("placement_snapshot_required"))
    rows = rows.withColumn("lead_status", F.first(F.when(F.col("leads"), leader), ignorenulls=True).over(Window.partitionBy(*key)))
    # a later row of a key meets what its leader left: a recorded row, or the same refusal (unless a placement came between)
    later = F.when(F.col("lead_status") == "recorded", F.when(F.col("payload_sha256") == F.col("first.payload_sha256"), "idempotent_skip").otherwise("snapshot_conflict_existing_payload")).when(F.col("snapshot_type") == "placement", F.col("lead_status"))
    rows = rows.withColumn("status", F.coalesce("status", F.when(F.col("leads"), leader), later, F.lit("placement_snapshot_required")))
    slots = F.when(F.col("status") == "idempotent_skip", F.coalesce("there_slot", "slot")).when(F.col("status") == "recorded", F.col("slot"))
    return rows.withColumn("daily_slot", F.when(F.col("snapshot_type") == "placement", slots)).select(*batch.columns, "daily_slot", "status")


def append_snapshots(batch: DataFrame, path: str) -> DataFrame:
    """Append what may be recorded of a batch to the table at path; seq, operation_id, snapshot_type, status and daily_slot of every row."""
    known = read_snapshots(batch.sparkSession, path)
    out = stored(judged(batch, known), "snapshots")
    names = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    out.where("status = 'recorded'").select(*names).write.mode("append").parquet(path)
    return out.select("seq", "operation_id", "snapshot_type", "status", "daily_slot")


def snapshot_stream(stream: DataFrame, path: str, checkpoint: str, seen: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """A stream of snapshots into the table at path; seen gets each batch's statuses."""

    def commit(batch: DataFrame, number: int) -> None:
        found = append_snapshots(batch, path)
        if seen:
            seen(found, number)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
