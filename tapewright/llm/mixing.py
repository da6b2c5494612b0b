"""Mixing sources to target weights, with DataFrame operations only.

Sources in code-point order (null last) have the weights WEIGHTS, repeating. They share all words by weight, up to
CAP times a source's own words; what lies above is shared by weight again. Each source's documents form a stream of words
that is cut into blocks of BLOCK words. Output shards of SHARD slots get their counts of the sources by a multinomial draw:
every slot draws a source by its share of all slots asked for. Draws leave a source some slots above or below what
its target asks for, so the totals are settled at the end: slots above it are left empty, and missing ones follow in a closing shard.
A source's k-th slot is mapped to a block by a pseudorandom permutation of its block numbers (swap-or-not rounds, another
permutation for each pass over the source), and blocks are joined by number.

Everything follows from hashes of the data and the seed, so reruns agree. Prefix sums run in three levels over hash buckets of
documents and groups of buckets, so a source with most of the rows is spread over tasks; rows that repeat are placed as one and
told apart afterwards. The per-source tables have a row for each source, for each source drawn in a shard, or for each cell of a source's numbers; a task
holds one cell's draws, one source's shards, or the list of sources. A source's last slot takes only as many words of its block as its target asks for.

Null text has no words: size 0, taken 0. Null sources form one source. Repeated rows and null ids are documents of their own.
A source without words has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import WORD_PATTERN, row_but_text, row_columns, stored, text_hash

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 32
SHARD = 65_536
#: Numbers in a cell in which draws meet the sources' ranges.
CELL = 65_536
ROUNDS = 12
SEED = 20
#: Documents in a bucket of the prefix sums, on average, and buckets in a group.
BUCKET_DOCS, GROUP_BUCKETS = 512, 512


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_no, source_size, target of each source of sized (source, size)."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a row for each source; its windows see no documents
    order = Window.orderBy(F.col("source").asc_nulls_last())
    own = own.withColumn("source_no", F.row_number().over(order))
    own = own.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int")))
    limit = F.col("source_size") * cap
    everything = Window.partitionBy(F.lit(1))
    by_ratio = everything.orderBy(limit / F.col("weight"), "source_no")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    # level: words for each unit of weight if all sources with a smaller ratio stop at their limit
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("weight").over(onward)
    own = own.withColumn("level", level).withColumn("open", limit / F.col("weight") >= F.col("level"))
    final = F.max(F.when(F.col("open"), F.col("level"))).over(everything)
    target = F.when(F.col("open"), F.col("weight") * final).otherwise(limit.cast("double"))
    return own.select("source", "source_no", "source_size", target.cast("double").alias("target"))


def placed(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The documents with their place in their source's stream, and the sources with their targets."""
    rows = docs.select("doc_id", "source", text_hash().alias("th"), word_count(F.col("text")).alias("size"))
    sized = stored(rows.groupBy("doc_id", "source", "th", "size").agg(F.count("*").alias("copies")), "mix-sized")
    sources = stored(source_targets(sized.select("source", (F.col("size") * F.col("copies")).alias("size"))), "mix-sources")
    buckets = max(1, math.ceil(sized.count() / BUCKET_DOCS))
    numbered = sized.join(sources.select(F.col("source").alias("_s"), "source_no"), sized.source.eqNullSafe(F.col("_s"))).drop("_s")
    numbered = numbered.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "th", F.lit(SEED)), F.lit(buckets))).withColumn("group", F.expr(f"bucket div {GROUP_BUCKETS}"))
    words = F.col("size") * F.col("copies")

    def ahead(key: list[str], order: list[str], what: Column) -> Column:
        return F.coalesce(F.sum(what).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    sums = stored(numbered.groupBy("source_no", "group", "bucket").agg(F.sum(words).alias("words")), "mix-sums")
    groups = sums.groupBy("source_no", "group").agg(F.sum("words").alias("words")).select("source_no", "group", ahead(["source_no"], ["group"], F.col("words")).alias("base"))
    starts = sums.withColumn("run", ahead(["source_no", "group"], ["bucket"], F.col("words"))).join(groups, ["source_no", "group"])
    starts = stored(starts.select("source_no", "bucket", (F.col("base") + F.col("run")).alias("base")), "mix-starts")
    out = numbered.withColumn("run", ahead(["source_no", "bucket"], ["doc_id", "th"], words)).join(starts, ["source_no", "bucket"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    placed_rows = out.select("doc_id", "th", "size", "source_no", (F.col("base") + F.col("run")).alias("at"), copy)
    return stored(placed_rows.select("doc_id", "th", "size", "source_no", (F.col("at") + F.col("copy") * F.col("size")).alias("at")), "mix-placed"), sources


def quotas(sources: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """source_no, blocks, quota, last_words, low of each source with words, and the sum of all quotas.

    quota is the number of slots in which a source's blocks make up its target, rounded to words: all blocks in every full pass, and in the last pass
    as many as are needed. Of the last slot's block only the first last_words words are taken, so a source of any size meets its target. The
    source's last block may be short, so its slot in the last pass counts. low is the sum of the quotas of the sources before.
    """
    live = sources.where("source_size > 0").select("source_no", "source_size", F.ceil(F.col("source_size") / block).alias("blocks"), F.round("target").cast("long").alias("goal"))
    live = live.withColumn("turn", F.expr("goal div source_size")).withColumn("rest", F.col("goal") % F.col("source_size"))
    live = permuted(live.withColumn("block", F.col("blocks") - 1), backward=True)  # block: the short block's slot in the last pass
    short = F.col("blocks") * block - F.col("source_size")
    past = F.col("rest") > F.col("block") * block
    used = F.ceil((F.col("rest") + F.when(past, short).otherwise(0)) / block)
    live = live.withColumn("used", used)
    in_last = F.col("rest") - (F.col("used") - 1) * block + F.when(F.col("used") - 1 > F.col("block"), short).otherwise(0)
    live = live.select("source_no", "blocks", (F.col("turn") * F.col("blocks") + F.col("used")).alias("quota"), F.when(F.col("used") > 0, in_last).otherwise(F.lit(block)).cast("long").alias("last_words"))
    before = Window.partitionBy(F.lit(1)).orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    live = stored(live.withColumn("low", F.coalesce(F.sum("quota").over(before), F.lit(0))), "mix-quotas")
    return live, live.agg(F.sum("quota")).first()[0] or 0


def shard_counts(live: DataFrame, total: int, shard: int = SHARD) -> DataFrame:
    """shard, source_no, n: a multinomial draw of the slots of each shard, by the sources' shares of all slots asked for.

    Every slot draws a number below the sum of all quotas and falls to the source whose range of numbers holds it. Numbers and ranges
    meet in cells of consecutive numbers, so a range is in as many cells as it is long, whatever the number of shards.
    """
    spark = live.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total)))
    draws = spark.range(0, total, 1, tasks).select(F.expr(f"id div {shard}").alias("shard"), number.alias("x"), F.lit(None).cast("int").alias("source_no"))
    cells = F.explode(F.sequence(F.expr(f"low div {CELL}"), F.expr(f"(low + quota - 1) div {CELL}"))).alias("cell")
    ranges = live.where("quota > 0").select(F.lit(None).cast("long").alias("shard"), F.col("low").alias("x"), "source_no", cells)
    walk = Window.partitionBy("cell").orderBy("x", F.col("source_no").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = draws.withColumn("cell", F.expr(f"x div {CELL}")).unionByName(ranges)
    hits = met.withColumn("hit", F.last("source_no", ignorenulls=True).over(walk)).where("source_no is null")
    return hits.groupBy("shard", F.col("hit").alias("source_no")).agg(F.count("*").alias("n"))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, source_no, slot (the source's running number), turn (pass over the source), block and words (taken of the block) of every output slot."""
    live, total = quotas(sources, block)
    counts = stored(shard_counts(live, total, shard), "mix-counts")
    by_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
    drawn = counts.join(live, "source_no").select("shard", "source_no", "blocks", "quota", "last_words", "first", F.least(F.col("n"), F.col("quota") - F.col("first")).alias("n"))
    had = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    # what the draws fall short of a source's quota makes up a closing shard
    short = live.join(had, "source_no", "left").withColumn("first", F.coalesce("had", F.lit(0)))
    closing = short.select(F.lit(-(-total // shard)).cast("long").alias("shard"), "source_no", "blocks", "quota", "last_words", "first", (F.col("quota") - F.col("first")).alias("n"))
    parts = drawn.unionByName(closing).where("n > 0")
    # stretches of a shard's length at most, spread over tasks before they become slots; a stated number of partitions is not coalesced
    parts = parts.withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {shard}")))).withColumn("at", F.col("first") + F.col("cut") * shard)
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(tasks, "source_no", "shard", "cut").withColumn("slot", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + shard, F.col("first") + F.col("n")) - 1)))
    words = F.when(F.col("slot") == F.col("quota") - 1, F.col("last_words")).otherwise(F.lit(block)).alias("words")
    dealt = dealt.select("shard", "source_no", "slot", "blocks", F.expr("slot div blocks").alias("turn"), (F.col("slot") % F.col("blocks")).alias("block"), words)
    return permuted(dealt).drop("blocks")


def permuted(df: DataFrame, rounds: int = ROUNDS, backward: bool = False) -> DataFrame:
    """Replace block by its image (backward: by what it is the image of) under a permutation of 0 .. blocks - 1 that source_no and turn select.

    In each round every number has a partner (a keyed reflection), and a keyed bit of the larger of the two decides
    whether they swap; both see the same bit, so each round is a permutation, and so are all together.
    """
    def step(now: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, "source_no", "turn"), F.col("blocks")) - now, F.col("blocks"))
        swap = F.xxhash64(r, F.lit(SEED), "source_no", "turn", F.greatest(now, partner)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, partner).otherwise(now)

    # a fold: rounds written one after another would repeat the expression of each in the next
    order = F.sequence(F.lit(rounds - 1), F.lit(0), F.lit(-1)) if backward else F.sequence(F.lit(0), F.lit(rounds - 1))
    return df.withColumn("block", F.aggregate(order, F.col("block"), step))


def pieces(places: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_no, block, ahead, at, low, high: the words low .. high - 1 (of its own) that the document at a place has in a block, behind ahead others of it."""
    end = F.col("at") + F.col("size")
    out = places.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))))
    return out.select(
        "source_no",
        "block",
        F.greatest(F.col("at") - F.col("block") * block, F.lit(0)).alias("ahead"),
        "at",
        (F.greatest(F.col("at"), F.col("block") * block) - F.col("at")).alias("low"),
        (F.least(end, (F.col("block") + 1) * block) - F.col("at")).alias("high"),
    )


def _within() -> Column:
    """How many of a piece's words are among the first words of its block."""
    return F.greatest(F.lit(0), F.least(F.col("high") - F.col("low"), F.col("words") - F.col("ahead")))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each row of docs."""
    places, sources = placed(docs)
    # written out: the planner would take the slots' size from the few rows that they come from, and broadcast them
    times = stored(slots(sources).groupBy("source_no", "block", "words").agg(F.count("*").alias("times")), "mix-times")
    taken = pieces(places).join(times, ["source_no", "block"]).groupBy("source_no", "at").agg(F.sum(_within() * F.col("times")).alias("taken"))
    out = places.join(taken, ["source_no", "at"], "left").join(sources.select("source_no", "source_size", "target"), "source_no")
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus with docs' columns: a row for each document and pass that took words of it, with the words taken.

    A text that is taken whole stays as it is; of others the taken words are joined by spaces. Of rows with one doc_id, source and
    text, one gives the other columns.
    """
    places, sources = placed(docs)
    # written out: the planner would take the slots' size from the few rows that they come from, and broadcast them
    chosen = stored(slots(sources).select("source_no", "block", "turn", "words"), "mix-slots")
    met = pieces(places).join(chosen, ["source_no", "block"]).withColumn("high", F.col("low") + _within()).where("high > low")
    runs = met.groupBy("source_no", "at", "turn").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("runs"), F.sum(F.col("high") - F.col("low")).alias("n"))
    named = places.where("size > 0").join(runs, ["source_no", "at"]).select("doc_id", "th", "source_no", "size", "runs", "n")
    texts = docs.select(row_but_text(docs), "text", F.col("doc_id").alias("id"), text_hash().alias("hash"), F.col("source").alias("named"))
    texts = texts.join(sources.select("source", F.col("source_no").alias("no")), texts.named.eqNullSafe(F.col("source"))).select("row", "text", "id", "hash", "no")
    again = stored(places.groupBy("doc_id", "th", "source_no").count().where("count > 1").select("doc_id", "th", "source_no"), "mix-again")
    if again.limit(1).count():  # repeated rows are places of their own, so one text serves them
        same = texts.id.eqNullSafe(again.doc_id) & (texts.hash == again.th) & (texts.no == again.source_no)
        texts = texts.join(again, same, "left_anti").unionByName(texts.join(again, same, "left_semi").dropDuplicates(["id", "hash", "no"]))
    out = texts.join(named, texts.id.eqNullSafe(named.doc_id) & (texts.hash == named.th) & (texts.no == named.source_no))
    words = F.regexp_extract_all("text", F.lit(f"({WORD_PATTERN})"), F.lit(1))

    def taken(w: Column) -> Column:
        return F.array_join(F.flatten(F.transform("runs", lambda r: F.slice(w, (r["low"] + 1).cast("int"), (r["high"] - r["low"]).cast("int")))), " ")

    # the words are an outer function's variable: as a column they would be folded into the inner one and split anew for each run
    cut = F.element_at(F.transform(F.array(words), taken), 1)
    return out.select("row", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("text")).alias("text")).select(*row_columns(docs.columns))
