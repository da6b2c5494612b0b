"""URL filters by dated lists, with DataFrame operations only.

A list entry names a domain, the day from which it holds and an action. The entries of a domain become validity intervals:
each holds until the day of the next. A capture is evaluated against the entries active at its fetch day, for its
host and every parent domain; the most specific domain with an active entry decides.

The as-of join is an equi-join on the domain and a salt with a range condition. Captures are reduced to distinct
(host, day) pairs first, so a host with most of the captures costs a row for each day; entries are copied once
for each salt.

Captures with a null or odd URL have a null host and no decision; so have captures without a fetch day. Null domains or days in a list are no entries; of several entries of one
domain and day the strictest holds (block, allow, remove). Repeated captures keep a row each. Empty tables give empty
results (an empty list: no decisions). Other columns of captures are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import stored

SALTS = 8
#: What an entry says, strictest first.
ACTIONS = ("block", "allow", "remove")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, _HOST, 2))
    return F.when(host != "", host)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """domain, action, valid_from, valid_to (exclusive, null: open) of list entries domain, day, action."""
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    known = entries.where("domain is not null and day is not null").withColumn("_rank", rank).where("_rank > 0")
    daily = known.groupBy("domain", "day").agg(F.min_by("action", "_rank").alias("action"))
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return daily.select("domain", "action", F.col("day").alias("valid_from"), following.alias("valid_to")).where("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame, salts: int = SALTS) -> DataFrame:
    """page_id, host, fetch_day, domain, action, valid_from of captures page_id, url, fetch_day."""
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), "fetch_day")
    asked = seen.where("host is not null and fetch_day is not null").select("host", "fetch_day").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = asked.select("host", "fetch_day", F.posexplode(suffixes).alias("depth", "domain")).withColumn("salt", F.pmod(F.xxhash64("host", "fetch_day"), F.lit(salts)).cast("int"))
    spans = validity_intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    active = asked.join(spans, (asked.domain == spans.domain) & (asked.salt == spans.salt) & (F.col("fetch_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to"))))
    # written out: the join below then has a plain exchange on either side, and a host with most captures of a day can be split
    said = stored(active.groupBy("host", "fetch_day").agg(F.min_by(F.struct(asked.domain.alias("domain"), "action", "valid_from"), "depth").alias("e")), "url-said")
    return seen.join(said, ["host", "fetch_day"], "left").select("page_id", "host", "fetch_day", "e.domain", "e.action", "e.valid_from")


def sample_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of a table of pages: up to three entries a host and one a parent domain, by hashes."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]+\.", ""))).alias("domain"), "host").select("domain").distinct()
    mix = F.md5(F.col("domain").cast("binary"))
    digit = lambda i, n: F.conv(F.substring(mix, i, n), 16, 10).cast("int")
    numbered = names.select("domain", mix.alias("mix"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"), *(digit(1 + 4 * i, 4).alias(f"d{i}") for i in range(4)))
    day = F.date_add(F.to_date(F.lit("2023-01-01")), F.element_at(F.array("d0", "d1", "d2"), F.col("i") + 1) % 730)
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("d3") + F.col("i")) % 3 + 1)
    return numbered.where("d3 % 4 >= i").select("domain", day.alias("day"), action.alias("action"))
