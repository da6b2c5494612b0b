"""Reports on operations: economics, grouped audits, signals, leaderboards, ledgers, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.functions.scalars import closure_type, plan_outcome, safe_double

MISSING = "sin_dato"


def normalised_economics(ops: DataFrame) -> DataFrame:
    """Operations with a reason for exclusion, or notional, risk, returns and R multiple.

    ops: operation_id, side, entry, margin, leverage, stop_loss, final_pnl, close_reason, plan_result. The first failing test names
    the reason.
    """
    x = {c: safe_double(F.col(c)) for c in ("entry", "margin", "leverage", "stop_loss", "final_pnl")}
    risk = F.when(F.col("side") == "long", (x["entry"] - x["stop_loss"]) / x["entry"]).otherwise((x["stop_loss"] - x["entry"]) / x["entry"])
    bad = lambda c: F.coalesce(x[c] <= 0, F.lit(True))
    reason = F.coalesce(
        F.when(~F.coalesce(F.col("side").isin("long", "short"), F.lit(False)), "invalid_side"),
        F.when(bad("entry"), "invalid_entry"),
        F.when(bad("margin"), "invalid_margin"),
        F.when(bad("leverage"), "invalid_leverage"),
        F.when(bad("stop_loss"), "invalid_stop_loss"),
        F.when(x["final_pnl"].isNull(), "missing_final_pnl"),
        F.when(risk <= 0, F.concat(F.lit("stop_not_adverse_to_"), F.col("side"))),
    )
    out = ops.withColumn("reason", reason).withColumn("_risk", F.when(F.col("reason").isNull(), risk)).withColumn("_notional", F.when(F.col("reason").isNull(), x["margin"] * x["leverage"]))
    return out.select(
        "operation_id",
        F.when(F.col("reason").isNull(), "included").otherwise("excluded").alias("status"),
        "reason",
        closure_type(F.col("close_reason")).alias("closure"),
        plan_outcome(F.col("plan_result")).alias("outcome"),
        F.round("_notional", 8).alias("notional"),
        F.round(F.col("_risk") * 100, 8).alias("risk_pct"),
        F.round(F.col("_notional") * F.col("_risk"), 8).alias("risk_amount"),
        F.round(x["final_pnl"] / F.col("_notional") * 100, 8).alias("return_pct"),
        F.round(F.when(F.col("reason").isNull(), x["final_pnl"] / x["margin"] * 100), 8).alias("margin_return_pct"),
        F.round(x["final_pnl"] / (F.col("_notional") * F.col("_risk")), 8).alias("r_multiple"),
    )


def max_drawdown(cases: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Largest fall of the running sum from its peak (which starts at 0)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = cases.withColumn("_sum", F.sum(value).over(w))
    run = run.withColumn("_fall", F.greatest(F.lit(0.0), F.max("_sum").over(w)) - F.col("_sum"))
    return run.groupBy(*keys).agg(F.max("_fall").alias("max_drawdown"), F.sum(value).alias("total"), F.count("*").alias("n"))


def grouped_cases(cases: DataFrame, key: str) -> DataFrame:
    """Counts, means and median of cases by a key; a missing key is a group of its own."""
    return cases.groupBy(F.coalesce(F.col(key).cast("string"), F.lit(MISSING)).alias("name")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "included").alias("n_included"),
        F.avg("r_multiple").alias("avg_r"),
        F.median("r_multiple").alias("median_r"),
        F.sum("margin_return_pct").alias("sum_margin_return"),
        F.count_if(F.col("outcome") == "take_profit").alias("n_take_profit"),
    )


def signal_effectiveness(cases: DataFrame, signals: str, success: Column, least: int) -> DataFrame:
    """Success rate by signal; a signal counts once in a case."""
    rows = cases.select("case_id", success.alias("_ok"), F.explode(F.array_distinct(signals)).alias("signal"))
    return rows.groupBy("signal").agg(F.count("*").alias("n"), F.avg(F.col("_ok").cast("double")).alias("rate"), F.min("case_id").alias("first_case")).where(F.col("n") >= least)


def signal_pairs(cases: DataFrame, signals: str, success: Column) -> DataFrame:
    """Success rate by unordered pair of signals in one case; a case has few signals, so its pairs are bounded."""
    s = F.array_sort(F.array_distinct(signals))
    pairs = F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = cases.select(success.alias("_ok"), F.explode(pairs).alias("p"))
    return rows.groupBy("p.a", "p.b").agg(F.count("*").alias("n"), F.avg(F.col("_ok").cast("double")).alias("rate"))


def latest_joined(left: DataFrame, right: DataFrame, key: str, order: Column, values: list[str]) -> DataFrame:
    """left with the latest right row of its key; the choice is an aggregation, so right is reduced before the join."""
    last = right.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("_v")).select(F.col(key).alias("_key"), "_v.*")
    return left.join(last, left[key] == F.col("_key"), "left").drop("_key")


def leaderboard(entries: DataFrame, ops: DataFrame, prices: DataFrame, balance: float) -> DataFrame:
    """user_id, realised, unrealised, open and closed counts, wins, losses, invested margin of open operations, and equity.

    ops: user_id, symbol, side, entry, margin, notional, status, pnl; open operations are marked to the symbol's price where there is one.
    """
    marked = ops.join(prices.select(F.col("symbol").alias("_s"), "price"), ops.symbol == F.col("_s"), "left").drop("_s")
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    floating = sign * F.col("notional") * (F.col("price") / F.col("entry") - 1)
    own = marked.groupBy("user_id").agg(
        F.sum(F.when(F.col("status") == "CLOSED", F.col("pnl")).otherwise(0.0)).alias("realised"),
        F.sum(F.when((F.col("status") == "OPEN") & F.col("price").isNotNull(), floating).otherwise(0.0)).alias("unrealised"),
        F.count_if(F.col("status") == "CLOSED").alias("n_closed"),
        F.count_if(F.col("status") == "OPEN").alias("n_open"),
        F.count_if((F.col("status") == "CLOSED") & (F.col("pnl") > 0)).alias("wins"),
        F.count_if((F.col("status") == "CLOSED") & (F.col("pnl") < 0)).alias("losses"),
        F.sum(F.when(F.col("status") == "OPEN", F.col("margin")).otherwise(0.0)).alias("invested"),
    )
    zero = {"realised": 0.0, "unrealised": 0.0, "n_closed": 0, "n_open": 0, "wins": 0, "losses": 0, "invested": 0.0}
    out = entries.join(own, "user_id", "left").fillna(zero)
    return out.withColumn("equity", balance + F.col("realised") + F.col("unrealised"))


def first_places(board: DataFrame, most: int) -> DataFrame:
    """The best rows of a board by equity (then user_id) with their place; only they are ranked, after a distributed top-k."""
    best = board.orderBy(F.desc("equity"), "user_id").limit(most)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("equity"), "user_id")))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """current with changes merged in: of each key the newest version stays, a tie goes to the change."""
    columns = current.columns
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.select(*columns).withColumn("_new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_v"))
    return best.select(*keys, "_v.*").select(*columns)


def insert_absent(current: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows whose key current does not have, one for each key."""
    return rows.dropDuplicates([key]).join(current.select(key), key, "left_anti")


def daily_slots(events: DataFrame, day: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each day, numbered; as many as a day may have."""
    w = Window.partitionBy(day).orderBy(*order)
    return events.withColumn("slot", F.row_number().over(w)).where(F.col("slot") <= most)
