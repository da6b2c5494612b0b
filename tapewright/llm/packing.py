"""Vector bin packing of examples into training sequences.

An example has a demand in several dimensions: tokens, segments and loss-bearing tokens. Bins have a limit in each. Within a
packing group the open bin takes, of the examples that fit in every dimension, the one with the largest dot product of its
demand and the bin's remaining room (both in units of the limits), until none fits.

Groups hold GROUP_ROWS examples on average, dealt by a hash of their ids, so no task sees all examples, and the waste of
a last bin is one part in hundreds. Examples that repeat are counted first and dealt by their number as well, so copies
without ids spread over the groups too. The result depends on the data alone: within a group examples are ordered by demand
and id.

Documents are cut into pieces first: whole sequences from the start, and one remainder to be packed with others. The cut
places are known when a document is tokenised, so only lengths and checksums are shuffled, never texts or ids.

Conversations are packed whole or in pieces as well; there only the ids of answers bear loss, and a sequence is limited in those too.

Null text counts as empty: a document of the closing id alone. Rows with a null doc_id and exactly repeated rows are
packed one by one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapewright.llm.common import slices, stored

SEQUENCE = 1024
#: Pieces of conversations in a sequence at most.
MAX_SEGMENTS = 64
END_ID = 0
#: Roles whose tokens bear loss in conversations, and the most of such tokens in a sequence.
LOSS_ROLES = ("assistant",)
MAX_LOSS = 768
GROUP_ROWS = 4096
_SPECIAL = "<|endoftext|>"
#: Fixed value: the split pattern of the byte-level vocabulary on texts whose white space is single.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\n"


class Tokens:
    """Ids of texts, as little-endian unsigned 32-bit bytes, from a byte-level BPE file of the tokenizers library.

    Most texts hold no white space but single spaces and line ends between visible characters, and no special token's
    string. On these the vocabulary's split pattern needs no look-ahead, and the ranks of the same vocabulary in the
    tiktoken library give the same ids several times faster. Other texts go to the tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranked = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def plain(text: str) -> bool:
        words = text.split()
        if not words or _SPECIAL in text or len(words) != text.count(" ") + text.count("\n") + 1:
            return False
        return sum(map(len, words)) + len(words) - 1 == len(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self.whole(texts)
        encode = self.ranked.encode_ordinary
        out = [array("I", encode(t)).tobytes() if self.plain(t) else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


def piece_lengths(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, n (ids with the closing one) and crcs (of each piece of at most sequence ids) for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    step = 4 * sequence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        for b in slices(batches, "text", 2_000_000):
            ids = [x + end for x in tokens.encode(pc.fill_null(b.column("text"), "").to_pylist())]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            crcs = pa.array([[zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)] for x in ids], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, crcs], ["doc_id", "n", "crcs"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, crcs array<long>")


def dot_product_bins(demands: np.ndarray, limits: np.ndarray) -> list[list[int]]:
    """Rows of demands in bins: each open bin takes the fitting row with the largest dot product with its room.

    Rows of equal demand are alike, so the search runs over distinct demands with counts. A row beyond the limits has a
    bin of its own.
    """
    if not len(demands):
        return []
    kinds, kind_of = np.unique(demands, axis=0, return_inverse=True)
    waiting: list[list[int]] = [[] for _ in kinds]
    for row in range(len(demands) - 1, -1, -1):
        waiting[kind_of.ravel()[row]].append(row)
    left = np.array([len(x) for x in waiting])
    bins = [[waiting[i].pop()] for i in np.flatnonzero((kinds > limits).any(axis=1)) for _ in range(left[i])]
    left[(kinds > limits).any(axis=1)] = 0
    weight = kinds / limits
    while left.any():
        alive = np.flatnonzero(left)
        kinds, weight, left = kinds[alive], weight[alive], left[alive]
        waiting = [waiting[i] for i in alive]
        for _ in range(256):  # drop finished kinds now and then only
            room, own = limits.astype(np.int64).copy(), []
            while True:
                fits = (kinds <= room).all(axis=1) & (left > 0)
                if not fits.any():
                    break
                gain = np.where(fits, weight @ (room / limits), -1.0)
                i = int(gain.argmax())
                own.append(waiting[i].pop())
                left[i] -= 1
                room -= kinds[i]
            if not own:
                break
            bins.append(own)
    return bins


def pack(examples: DataFrame, order: list[str], limits: dict[str, int], group_rows: int = GROUP_ROWS) -> DataFrame:
    """examples with sequence_id and offset (first token's place): all that share a sequence keep within limits.

    limits maps demand columns to their limits; the first of them counts tokens. order names columns that fix the order
    of examples.
    """
    groups = max(1, math.ceil(examples.count() / group_rows))
    key = F.pmod(F.xxhash64(*order, "_copy"), F.lit(groups)).cast("int")
    columns = examples.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in examples.schema.fields)
    examples = examples.groupBy(*columns).agg(F.count("*").alias("_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    most = np.array(list(limits.values()))

    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(order, kind="stable").reset_index(drop=True)
        demands = df[list(limits)].to_numpy(np.int64)
        seq, offset = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
        for i, rows in enumerate(dot_product_bins(demands, most)):
            seq[rows] = i
            offset[rows] = np.cumsum(demands[rows, 0]) - demands[rows, 0]
        df["sequence_id"] = (df["_group"].to_numpy(np.int64) << 32) + seq
        df["offset"] = offset
        return df[[*columns, "sequence_id", "offset"]]

    return examples.select(*columns, key.alias("_group")).groupBy("_group").applyInPandas(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, segments: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs.

    By default a sequence may hold a piece for each of its tokens, so texts of a few tokens fill it.

    A piece's first id has no earlier one to predict it from, so a piece of n ids bears loss on n - 1.
    """
    lengths = stored(piece_lengths(docs, tokenizer, sequence), "pack-lengths")
    pieces = lengths.select("doc_id", F.col("n").alias("doc_tokens"), F.posexplode("crcs").alias("p", "ids_crc32")).select(
        "doc_id",
        (F.col("p").cast("long") * sequence).alias("start"),
        F.least(F.lit(sequence).cast("long"), F.col("doc_tokens") - F.col("p").cast("long") * sequence).alias("length"),
        "ids_crc32",
        "doc_tokens",
    )
    demands = pieces.withColumn("segments", F.lit(1)).withColumn("loss_tokens", F.col("length") - 1)
    packed = pack(demands, ["doc_id", "start", "ids_crc32", "doc_tokens"], {"length": sequence, "segments": segments, "loss_tokens": sequence - 1})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def conversation_pieces(turns: DataFrame, tokenizer: str, roles: tuple[str, ...] = LOSS_ROLES, sequence: int = SEQUENCE) -> DataFrame:
    """conv_id, start, length, loss_tokens, conv_tokens of each piece of each conversation of turns (conv_id, turn, role, text).

    A conversation is its turns' ids in order of turn, each with the closing id; those of roles bear loss. It is cut into whole sequences
    from the start and one remainder.
    """
    turns = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer)
        for b in slices(batches, "text", 2_000_000):
            n = pa.array([len(x) // 4 + 1 for x in tokens.encode(b.column("text").to_pylist())], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "turn", "role")), n], ["conv_id", "turn", "role", "n"])

    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn", "role"))
    counted = turns.mapInArrow(run, f"{kinds}, n long")
    # a turn as a stretch of its conversation, then the part of it that lies in each piece
    ahead = Window.partitionBy("conv_id").orderBy("turn", "role", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("at", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long")))
    cut = placed.withColumn("p", F.explode(F.sequence(F.expr(f"at div {sequence}"), F.expr(f"(at + n - 1) div {sequence}"))))
    inside = F.least(F.col("at") + F.col("n"), (F.col("p") + 1) * sequence) - F.greatest(F.col("at"), F.col("p") * sequence)
    loss = F.when(F.col("role").isin(*roles), inside).otherwise(F.lit(0))
    pieces = cut.groupBy("conv_id", "p").agg(F.sum(inside).alias("length"), F.sum(loss).cast("long").alias("loss_tokens"))
    total = F.sum("length").over(Window.partitionBy("conv_id"))
    return pieces.select("conv_id", (F.col("p") * sequence).alias("start"), "length", "loss_tokens", total.alias("conv_tokens"))


def pack_conversations(turns: DataFrame, tokenizer: str, sequence: int = SEQUENCE, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS) -> DataFrame:
    """conversation_pieces in sequences of at most sequence tokens, segments pieces and loss loss-bearing tokens; sequence_id, offset.

    A piece that alone bears more loss than allowed has a sequence of its own. Null conv_ids are one conversation; null text is an empty turn.
    """
    pieces = stored(conversation_pieces(turns, tokenizer, sequence=sequence), "pack-turns").withColumn("segments", F.lit(1))
    packed = pack(pieces, ["conv_id", "start", "length", "loss_tokens", "conv_tokens"], {"length": sequence, "segments": segments, "loss_tokens": loss})
    return packed.drop("segments")
