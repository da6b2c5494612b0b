"""Vector code compression: product codes whose nearest entries are found in kd-trees.

Vectors are cut into PARTS equal consecutive parts, each with a codebook of ENTRIES entries that starts as that part of the vectors
with the smallest vec_ids. Every round broadcasts a kd-tree for each codebook. A task searches the trees for a batch of rows at once by branch and
bound: rows go to a node while its box is no farther than their best entry so far. Boxes at an equal distance are visited too, since an entry with
a lower index may lie in them. Tasks add up components in integers, one row for each entry's component leaves a task, and Spark adds these up;
so the driver gets as many sums as codebooks have components, however long the table.

Components are floor(256 * x), kept within the range of long. Distances are exact: in 64-bit integers where they fit, in Python's integers where they
don't; errors stop at the largest long.

Vectors that are null, or hold a null or non-finite component, are dropped. Shorter vectors count as padded with 0, to the longest one's length
and then to a multiple of PARTS. Repeated rows and rows with a null vec_id are coded like any other; a codebook starts from distinct non-null ids,
of rows with one id from the one with the smallest vector. Fewer ids make fewer entries; if there is no id at all, the one entry is 0. Null labels are one label.
An empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import stored
from tapewright.llm.maxscore import usable

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Entries in a leaf of a tree at most, where they differ at all.
LEAF = 8
MOST_LONG = (1 << 63) - 1


class Tree:
    """A kd-tree over one codebook (entries as rows of integers)."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.most = int(np.abs(entries.astype(object)).max(initial=0))
        self.root = self._grow(np.arange(len(entries)))

    def _grow(self, own: np.ndarray) -> tuple:
        """(low, high, indices, None, None, None) of a leaf or (low, high, None, axis, left, right): boxes hold all entries below."""
        x = self.entries[own]
        low, high = x.min(axis=0), x.max(axis=0)
        wide = [int(b) - int(a) for a, b in zip(low, high, strict=True)]
        axis = int(np.argmax(np.array(wide, object))) if wide else 0
        if len(own) <= LEAF or not wide or not wide[axis]:
            return low, high, own, None, None, None
        order = own[np.argsort(x[:, axis], kind="stable")]
        half = len(order) // 2
        return low, high, None, axis, self._grow(np.sort(order[:half])), self._grow(np.sort(order[half:]))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry's index of each row of x, ties to the lower one, and its squared distance."""
        reach = 2 * max(self.most, int(np.abs(x.astype(object)).max(initial=0)) if x.dtype == object else max(int(x.max(initial=0)), -int(x.min(initial=0))))
        exact = x.shape[1] * reach * reach <= 1 << 62
        kind = np.int64 if exact else object
        x, entries = x.astype(kind), self.entries.astype(kind)
        best = np.full(len(x), MOST_LONG if exact else 1 << 200, kind)
        code = np.full(len(x), len(entries), np.int64)

        def visit(node: tuple, rows: np.ndarray) -> None:
            low, high, own, axis, left, right = node
            if not len(rows):
                return
            at = x[rows]
            out = np.maximum(np.maximum(low.astype(kind) - at, at - high.astype(kind)), 0)
            near = (out * out).sum(axis=1) <= best[rows]
            rows, at = rows[near], at[near]
            if own is not None:
                for i in own:
                    gap = at - entries[i]
                    d = (gap * gap).sum(axis=1)
                    better = (d < best[rows]) | ((d == best[rows]) & (i < code[rows]))
                    best[rows[better]], code[rows[better]] = d[better], i
                return
            first = (at[:, axis] - int(left[1][axis]) <= int(right[0][axis]) - at[:, axis]).astype(bool)
            visit(left, rows[first])
            visit(right, rows)
            visit(left, rows[~first])

        visit(self.root, np.arange(len(x)))
        return code, best


def padded(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones padded with 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def integer_vectors(df: DataFrame) -> DataFrame:
    """vec_id, label, v (integer components) of the rows that take part."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return df.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", whole.alias("v"))


def first_codebooks(kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks of the vectors with the smallest ids; ids are found without their vectors."""
    ids = [r[0] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("v").alias("v")).collect() if ids else []
    x = np.zeros((max(1, len(rows)), width), np.int64)
    for i, r in enumerate(sorted(rows, key=lambda r: r["vec_id"])):
        x[i, : len(r["v"])] = r["v"]
    return np.split(x, parts, axis=1)


def updated(kept: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: used entries become the floor of their parts' mean."""
    width = sum(b.shape[1] for b in books)
    shared = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        sums = [np.zeros(t.entries.shape, object) for t in trees]
        used = [np.zeros(len(t.entries), np.int64) for t in trees]
        for b in batches:
            for p, (t, x) in enumerate(zip(trees, np.split(padded(b.column("v"), width), len(trees), axis=1), strict=True)):
                code, _ = t.nearest(x)
                used[p] += np.bincount(code, minlength=len(t.entries))
                # two halves of each component, so that sums of a batch stay within 64 bits
                for shift, half in ((32, x >> 32), (0, x & 0xFFFFFFFF)):
                    own = np.zeros(t.entries.shape, np.int64)
                    np.add.at(own, code, half)
                    sums[p] += own.astype(object) << shift
        found = [(p, e, k, Decimal(int(sums[p][e, k])), int(used[p][e])) for p, s in enumerate(sums) for e in np.flatnonzero(used[p]) for k in range(s.shape[1])]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(types)], ["part", "entry", "k", "total", "n"])

    partial = kept.select("v").mapInArrow(run, "part int, entry int, k int, total decimal(38,0), n long")
    books = [b.copy() for b in books]
    # a row for each component of each codebook
    for r in partial.groupBy("part", "entry", "k").agg(F.sum("total").cast("decimal(38,0)").alias("total"), F.sum("n").alias("n")).collect():
        books[r["part"]][r["entry"], r["k"]] = int(r["total"]) // r["n"]
    return books


def coded(kept: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each row of kept."""
    width = sum(b.shape[1] for b in books)
    shared = kept.sparkSession.sparkContext.broadcast([Tree(b) for b in books])
    kind = kept.schema["label"].dataType.simpleString()
    hexes = [f"{i:02x}" for i in range(256)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for b in batches:
            found = [t.nearest(x) for t, x in zip(trees, np.split(padded(b.column("v"), width), len(trees), axis=1), strict=True)]
            codes = ["".join(hexes[i] for i in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
            errors = np.minimum(sum(d.astype(object) for _, d in found), MOST_LONG)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors.tolist(), pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def fitted(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """The codebooks of kept after the given rounds; None of an empty table."""
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return None
    books = first_codebooks(kept, -(-longest // parts) * parts, parts, entries)
    for _ in range(rounds):
        books = updated(kept, books)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for c in b.ravel()).encode()).hexdigest()


def code_vectors(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row of df (vec_id, embedding, label) that takes part."""
    kept = integer_vectors(df)
    books = fitted(kept)
    if books is None:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    rows = stored(coded(kept, books), "codes")
    # written out as well, so the join is planned by the true size: broadcast if small, else sorted, with hot labels split
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    sums = stored(rows.groupBy(F.col("label").alias("same")).agg(total.alias("label_error")), "codes-labels")
    out = rows.join(sums, rows["label"].eqNullSafe(sums["same"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
