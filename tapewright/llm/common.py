"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright import storage

#: Words are runs of bytes other than space and tab..carriage return; bytes.split() and this pattern agree.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset and the session local."""
    root = storage.shared_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root for one run of an operator."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a map of hashes: broadcast as at most BITS / 64 rows, whatever the number of keys.
BITS = 1 << 25


def _bit(*keys: str) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit(BITS - 1))


def bit_map(df: DataFrame, *keys: str) -> DataFrame:
    """word, bits: a map of the hashes of df's keys, of a fixed size."""
    at = df.select(_bit(*keys).alias("at"))
    bit = F.expr("shiftleft(1L, CAST(at & 63 AS INT))")
    return stored(at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "bit-map")


def by_bit_map(rows: DataFrame, words: DataFrame, *keys: str, also: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """rows whose keys may be in the map's, and those whose keys surely are not (or for which also is false).

    Only the former have to meet the keys in a shuffle. With far more keys than bits all rows may be in it, which costs time but no result.
    """
    own = words.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    met = (F.shiftright(_bit(*keys), 6) == F.col("_word")) & (F.expr("shiftright(_bits, CAST(xxhash64({0}) & 63 AS INT)) & 1".format(", ".join(f"`{k}`" for k in keys))) == 1)
    met = met if also is None else met & also
    return rows.join(F.broadcast(own), met, "left_semi"), rows.join(F.broadcast(own), met, "left_anti")


def text_hash(text: Column | str = "text") -> Column:
    """64 bits of a text; with doc_id it tells rows apart (null text: like empty)."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def row_but_text(docs: DataFrame) -> Column:
    """All columns of docs but text as one struct, row, so that no name of theirs meets an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row")


def row_columns(columns: list[str]) -> list[Column]:
    """The columns of that name again, from row and text."""
    return [(F.col("text") if c.lower() == "text" else F.col("row").getField(c)).alias(c) for c in columns]


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about most_bytes of one text column; a longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        groups = np.cumsum(sizes, dtype=np.int64) // most_bytes
        edges = np.flatnonzero(np.diff(groups, prepend=-1, append=-2))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(int(a), int(b - a))


def utf8_rows(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an uint64 array."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
