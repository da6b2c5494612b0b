"""Audit of how filters overlap: every order of five filters is replayed on every document.

Each document gets the set of filters that it fails, as bits. Documents are crossed with the broadcast orders (120 rows, whatever the data); the
first step whose filter fails is computed, the five steps are exploded, and conditional sums by part, order and step are combined before
their shuffle. A part, hot or not, leaves 600 rows a task.

Copies (filter E) are told by SHA-256 of the text. The smallest id of each text that has more than one row is kept in a table. Texts that hold
a thousandth of all rows or more, of which there are 1000 at most, are met by broadcast; the others by a shuffle in which no key is hot.

Null text counts as empty, null lang as the part ''. A null doc_id is no smaller than any other and has none smaller, so E never removes such a row;
rows that repeat one doc_id are documents of their own and no copies of each other by that alone. A document is good or toxic if any label row of its id says
so. Every part has all 600 rows, with zeros; an empty table has no part. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import stored

FILTERS = "ABCDE"
#: Rows of one text, as a share of all, from which it is met by broadcast: at most HOT texts hold so many.
HOT = 1000


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails (bit 0: A)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    short = n < 200
    repeats = F.size(F.array_distinct(words)) * 100 < n * 50
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 3
    signs = text.rlike("[#$%&*|]")
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate((short, repeats, capitals, signs))), F.lit(0))


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, bits of each row of docs, bits without filter E."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), failures(text).alias("bits"))


def with_copies(rows: DataFrame) -> DataFrame:
    """rows (stored, as judged gives them) with filter E in their bits: copies of a text of a smaller doc_id."""
    n = rows.count()
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = stored(firsts, "audit-firsts")
    hot = F.col("copies") * HOT >= n
    many = F.broadcast(firsts.where(hot).select("digest", "first"))  # at most HOT rows
    few = firsts.where(~hot).select("digest", "first")
    common = rows.join(many, "digest")
    others = rows.join(many.select("digest"), "digest", "left_anti").join(few, "digest", "left")
    both = common.unionByName(others)
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", F.when(copy, F.col("bits") + 16).otherwise(F.col("bits")).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic: whether any label row of the same id says so."""
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = rows.join(said, rows["doc_id"] == said["id"], "left")
    return out.select("part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def orders(df: DataFrame) -> DataFrame:
    """order_no, filter_order, and bit_1 to bit_5: the filters of the steps as bits."""
    rows = [(i, "".join(p), *(1 << FILTERS.index(f) for f in p)) for i, p in enumerate(permutations(FILTERS))]
    return df.sparkSession.createDataFrame(rows, "order_no int, filter_order string, " + ", ".join(f"bit_{i} int" for i in range(1, 6)))


def replay(rows: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, of rows (part, bits, good, toxic)."""
    every = orders(rows)
    fails = [F.col("bits").bitwiseAND(F.col(f"bit_{i}")) != 0 for i in range(1, 6)]
    first = F.lit(6)  # none fails
    for i in range(5, 0, -1):
        first = F.when(fails[i - 1], F.lit(i)).otherwise(first)
    played = rows.crossJoin(F.broadcast(every.drop("filter_order"))).withColumn("first", first)
    steps = played.withColumn("step", F.explode(F.array(*map(F.lit, range(1, 6)))))
    bit = F.col("bit_5")
    for i in range(4, 0, -1):
        bit = F.when(F.col("step") == i, F.col(f"bit_{i}")).otherwise(bit)
    steps = steps.select("part", "order_no", "step", "first", "good", "toxic", "bits", bit.alias("bit"))
    removed = F.col("first") == F.col("step")

    def count(c: Column, name: str) -> Column:
        return F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))).cast("long").alias(name)

    counts = steps.groupBy("part", "order_no", "step").agg(
        count(F.col("first") > F.col("step"), "kept"),
        count(removed, "removed"),
        count((F.col("first") < F.col("step")) & (F.col("bits").bitwiseAND(F.col("bit")) != 0), "redundant"),
        count(F.col("bits") == F.col("bit"), "unique_fails"),
        count(removed & F.col("good"), "good_lost"),
        count(removed & F.col("toxic"), "toxic_lost"),
    )
    named = counts.join(F.broadcast(every.select("order_no", "filter_order")), "order_no")
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    # a filter stands once in each order: 120 rows a group
    shapley = F.sum("removed").over(Window.partitionBy("part", own)).alias("shapley")
    return named.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of every part, order and step of docs (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    rows = with_copies(stored(judged(docs), "audit-rows"))
    return replay(with_labels(rows, labels))
