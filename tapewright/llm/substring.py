"""Substring deduplication by relative Lempel-Ziv parsing.

A window is WINDOW consecutive words of one document. A document is parsed against the reference blocks of all documents with
smaller ids: a factor copies a run of windows from one place (document and word) of a reference, and the words under
factors are duplicate spans.

Blocks are content-defined. The key of a window is the least hash of its GRAM-word sequences, so equal windows have equal keys
wherever they lie, and consecutive windows with one key form a block. The index holds every block whose key several documents
have: key, a hash of all its words, and the smallest place it has. A block that the index has at a smaller document is a piece
of a factor as it stands. Where a key is shared but the block's words differ, its text is at a factor boundary: its
windows are hashed one by one and looked up among the windows of such blocks, which gives pieces of one window. Each block
content is looked up once, for the smallest document that has it; all others are whole pieces. Unshared keys, the bulk of a
corpus, are dropped after one count.

Each document is then parsed from left to right: the pieces that go on where the last one ended in the same reference
lengthen the open factor, and any other opens the next. Every factor is checked on the words themselves: cut on a grid of CELL
reference words, with the parts at its boundaries, its words have to agree with the reference's (128-bit digests of the
words). If any factor fails, hashes met by accident, and the parse is made again with other hashes.

doc_id is an integer. Null text has no words. Rows with a null doc_id are no reference and lose nothing; rows that share a doc_id
are not references for each other. Exactly repeated rows keep one result each. An empty table gives an empty result. Columns other
than doc_id and text are ignored, or passed on by remove_spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tapewright.llm.common import bit_map, by_bit_map, row_but_text, row_columns, slices, splitmix, stored, text_hash, utf8_rows

WINDOW = 50
GRAM = 10
#: Windows in a block at most (blocks of long repetitions are cut).
BLOCK = 256
#: Words of more bytes have a digest of their own, as the polynomial takes tens of bytes of memory for each byte.
GIANT = 1 << 16
#: Bytes of a text hashed at a time.
PART = 1 << 20
#: Words of a reference in a cell of the grid on which factors are checked, and parses tried before giving up.
CELL, TRIES = 256, 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[ \t-\r]")
_WORD, _LONG = (int(x) | 1 for x in splitmix(np.arange(1001, 1003, dtype=np.uint64)))


@lru_cache
def _table(seed: int) -> tuple[np.ndarray, int]:
    """The values of bytes and the base of the words' polynomial."""
    start = np.uint64(seed << 32)
    return splitmix(start + np.arange(256, dtype=np.uint64)), int(splitmix(start + np.arange(1000, 1001, dtype=np.uint64))[0]) | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(max(1, n), np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base ** (done + i) = base ** done * base ** i
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
        done += more
    return out


def word_hashes(text: bytes, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone; long texts are hashed part by part."""
    if len(text) <= PART:
        return _part_hashes(text, seed)
    out, at = [], 0
    while at < len(text):
        m = _BLANK.search(text, at + PART)
        end = m.start() if m else len(text)
        out.append(_part_hashes(text[at:end], seed))
        at = end
    return np.concatenate(out)


def _part_hashes(text: bytes, seed: int) -> np.ndarray:
    b = np.frombuffer(text, np.uint8)
    edge = np.diff((~_SPACE[b]).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    giant = sizes > GIANT
    if not giant.any():
        return _hash_words(b, starts, sizes, seed)
    out = np.empty(len(starts), np.uint64)
    salt = seed.to_bytes(8, "little")
    out[giant] = [int.from_bytes(hashlib.blake2b(text[i:j], digest_size=8, salt=salt).digest(), "little") for i, j in zip(starts[giant], ends[giant], strict=True)]
    out[~giant] = _part_hashes(b" ".join(text[i:j] for i, j in zip(starts[~giant], ends[~giant], strict=True)), seed)
    return out


def _hash_words(b: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    values, base = _table(seed)
    most = int(sizes.max())
    b = b[starts[0] :]
    at = starts - starts[0]
    place = np.arange(len(b)) - np.repeat(at, np.diff(np.append(at, len(b))))
    value = np.where(_SPACE[b], np.uint64(0), values[b] * _powers(base, most + 1)[np.minimum(place, most)])
    return splitmix(np.add.reduceat(value, at) + sizes.astype(np.uint64))


def rolling(values: np.ndarray, n: int, base: int) -> np.ndarray:
    """A mixed hash of every n consecutive values: polynomials modulo 2 ** 64 by prefix doubling."""
    m = len(values) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    part, size, done = values, 1, 0
    while True:  # part[i] is the polynomial of size values from i
        if n & size:
            total = total + part[done : done + m] * np.uint64(pow(base, done, 1 << 64))
            done += size
        if done == n:
            return splitmix(total)
        part = part[:-size] + part[size:] * np.uint64(pow(base, size, 1 << 64))
        size *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    part, size = values, 1
    while 2 * size <= n:
        part = np.minimum(part[:-size], part[size:])
        size *= 2
    return np.minimum(part[: len(values) - n + 1], part[n - size : n - size + len(values) - n + 1])


def window_keys(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The key of each window: the least hash of its gram-word sequences."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    return sliding_min(rolling(words, gram, _WORD), window - gram + 1)


def blocks(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """key, hash of all words, first window and number of windows of each block."""
    keys = window_keys(words, window, gram)
    if not len(keys):
        return keys, keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(fresh, len(keys)))
    if sizes.max() > BLOCK:
        fresh = np.concatenate([np.arange(s, s + n, BLOCK) for s, n in zip(fresh, sizes, strict=True)])
        sizes = np.diff(np.append(fresh, len(keys)))
    # the hash of words a..b from prefix sums; the powers are odd, so dividing them out is a multiplication
    inverse = pow(_LONG, -1, 1 << 64)
    sums = np.append(np.uint64(0), np.cumsum(words * _powers(_LONG, len(words)), dtype=np.uint64))
    content = (sums[fresh + sizes + window - 1] - sums[fresh]) * _powers(inverse, len(words))[fresh]
    return keys[fresh], splitmix(content + sizes.astype(np.uint64)), fresh, sizes


def _over_texts(docs: DataFrame, fn: Callable[[bytes], list[np.ndarray]], names: list[str], schema: str) -> DataFrame:
    """Rows that fn gives for each text, with the row's doc_id and text hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, "text", 2_000_000):
                parts = [fn(x) for x in utf8_rows(b.column("text"))]
                at = pa.array(np.repeat(np.arange(b.num_rows), [len(p[0]) for p in parts]))
                columns = [np.concatenate([p[i] for p in parts]) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns)], ["doc_id", "th", *names])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, {schema}")


def _place() -> Column:
    """Document and word as one number: of a group's places the smallest is that of the smallest document."""
    return F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("start")


def _lowest() -> list[Column]:
    return [F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(_place()).alias("place")]


def _ref_start() -> Column:
    return (F.col("place") - F.col("low").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)")).cast("int").alias("ref_start")


def reference_pieces(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, seed: int = 0) -> DataFrame:
    """doc_id, th (text hash), pieces of docs (doc_id, text): windows start .. start + n - 1 are those of document ref from ref_start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("th"))
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = _over_texts(known, lambda x: list(blocks(word_hashes(x, seed), window, gram)), ["key", "content", "start", "n"], "key long, content long, start long, n long")
    found = stored(found.withColumn("start", F.col("start").cast("int")).withColumn("n", F.col("n").cast("int")), "rlz-blocks")
    contents = found.groupBy("key", "content").agg(*_lowest())
    shared = contents.groupBy("key").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count("*").alias("variants")).where("least < most").select("key", "variants")
    index = stored(contents.join(shared, "key").select("key", "content", "low", _ref_start(), "variants"), "rlz-index")
    # an exchange on either side: a key that a large part of the rows have can be split
    looked = stored(found.join(index, ["key", "content"]).select("doc_id", "th", "key", "content", "start", "n", "low", "ref_start", "variants"), "rlz-looked")
    whole = looked.where("low < doc_id").select("doc_id", "th", "start", "n", "low", "ref_start")
    edge = looked.where("low = doc_id and variants > 1")
    checks = edge.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, "text", 1_000_000):
                rows, out = [], []
                for i, (text, todo) in enumerate(zip(utf8_rows(b.column("text")), b.column("b").to_pylist(), strict=True)):
                    words = word_hashes(text, seed)
                    keys, hashes = window_keys(words, window, gram), rolling(words, window, _LONG)
                    at = np.unique(np.concatenate([np.arange(x["start"], x["start"] + x["n"]) for x in todo]))
                    rows.append(np.full(len(at), i))
                    out.append((keys[at].view(np.int64), hashes[at].view(np.int64), at.astype(np.int32)))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), *(pa.array(np.concatenate([o[i] for o in out])) for i in range(3))], ["doc_id", "th", "key", "hash", "start"])

    texts = docs.join(checks, ["doc_id", "th"]).select("doc_id", "th", "text", "b").dropDuplicates(["doc_id", "th"])
    windows = stored(texts.mapInArrow(run, "doc_id long, th long, key long, hash long, start int"), "rlz-windows")
    owners = stored(windows.groupBy("key", "hash").agg(*_lowest()).where("low < high").select("key", "hash", "low", _ref_start()), "rlz-owners")
    single = windows.join(owners, ["key", "hash"]).where("low < doc_id").select("doc_id", "th", "start", F.lit(1).alias("n"), "low", "ref_start")
    # every window has one piece at most, so a document's list is no longer than its text
    return whole.union(single).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "n", F.col("low").alias("ref"), "ref_start")).alias("pieces"))


def factors(pieces: list[dict]) -> list[tuple[int, int, int, int]]:
    """The parse from left to right: start, windows, ref and ref_start of each factor, as long as its reference goes on."""
    out: list[list[int]] = []
    for p in sorted(pieces, key=lambda p: p["start"]):
        if out and (last := out[-1])[2] == p["ref"] and last[0] + last[1] == p["start"] and last[3] + last[1] == p["ref_start"]:
            last[1] += p["n"]
        else:
            out.append([p["start"], p["n"], p["ref"], p["ref_start"]])
    return [tuple(f) for f in out]


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def cells(words: list[bytes], parse: list[tuple[int, int, int, int]], window: int) -> list[dict]:
    """The factors' words on the grid of their references: ref, first and end word there, digest of the words here."""
    out = []
    for start, n, ref, ref_start in parse:
        end, at = ref_start + n + window - 1, ref_start
        while at < end:
            stop = min(end, (at // CELL + 1) * CELL)
            out.append({"ref": ref, "at": at, "stop": stop, "digest": _digest(words[at + start - ref_start : stop + start - ref_start])})
            at = stop
    return out


_CELLS = pa.list_(pa.struct([("ref", pa.int64()), ("at", pa.int32()), ("stop", pa.int32()), ("digest", pa.binary())]))


def proven(docs: DataFrame, claimed: DataFrame) -> bool:
    """Whether all cells claimed (ref, at, stop, digest) hold on the words of their references, the rows of docs with doc_id ref.

    Cells of copies are alike and are checked once. A reference has at most CELL ** 2 / 2 different cells for each CELL words.
    """
    claimed = stored(claimed.distinct(), "rlz-claimed")
    asked = claimed.groupBy("ref").agg(F.collect_list(F.struct("at", "stop", "digest")).alias("cells"))
    texts = docs.select(F.col("doc_id").cast("long").alias("ref"), "text").join(asked, "ref")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = []
            for ref, text, wanted in zip(b.column("ref").to_pylist(), utf8_rows(b.column("text")), b.column("cells").to_pylist(), strict=True):
                words = text.split()
                found += [(ref, c["at"], c["stop"], c["digest"]) for c in wanted if _digest(words[c["at"] : c["stop"]]) == c["digest"]]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t.type) for i, t in enumerate(_CELLS.value_type)], ["ref", "at", "stop", "digest"])

    held = texts.mapInArrow(run, "ref long, at int, stop int, digest binary").distinct()
    return held.count() == claimed.count()


def _covered(n_words: int, parse: list[tuple[int, int, int, int]], window: int) -> np.ndarray:
    """Which words the factors' windows cover."""
    mark = np.zeros(n_words + 1, np.int64)
    for start, n, _, _ in parse:
        mark[start] += 1
        mark[start + n + window - 1] -= 1
    return np.cumsum(mark[:-1]) > 0


def parsed(docs: DataFrame, make: Callable[[bytes, list[bytes], np.ndarray], tuple], fields: list[tuple[str, str, pa.DataType]], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """row (docs' columns but text) and the fields that make gives for a text, its words and which of them are duplicate.

    Only a parse whose factors all hold on their references' words is returned.
    """
    docs = docs.withColumn("text", F.col("text").cast("string"))
    own = docs.select(row_but_text(docs), "text", F.col("doc_id").cast("long").alias("id"), text_hash().alias("hash"))
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made, claims = [], []
            for text, pieces in zip(utf8_rows(b.column("text")), b.column("pieces").to_pylist(), strict=True):
                words, parse = text.split(), factors(pieces or [])
                claims.append(cells(words, parse, window))
                made.append(make(text, words, _covered(len(words), parse, window)))
            columns = [pa.array([m[i] for m in made], f[2]) for i, f in enumerate(fields)]
            if "cut" in names:  # of the others the text stays, null or not
                columns[0] = pc.if_else(columns[1], columns[0], b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("row"), *columns, pa.array(claims, _CELLS)], ["row", *names, "cells"])

    schema = StructType().add("row", own.schema["row"].dataType)
    for name, kind, _ in fields:
        schema = schema.add(name, kind)
    schema = schema.add("cells", ArrayType(StructType().add("ref", "long").add("at", "integer").add("stop", "integer").add("digest", "binary")))
    for seed in range(TRIES):
        pieces = stored(reference_pieces(docs, window, gram, seed), "rlz-pieces")
        # texts without a piece stay where they are
        perhaps, others = by_bit_map(own, bit_map(pieces.select(F.col("doc_id").alias("id"), F.col("th").alias("hash")), "id", "hash"), "id", "hash")
        marked = perhaps.join(pieces, (perhaps.id == pieces.doc_id) & (perhaps.hash == pieces.th), "left").select("row", "text", "pieces")
        marked = marked.unionByName(others.select("row", "text", F.lit(None).cast(pieces.schema["pieces"].dataType).alias("pieces")))
        out = stored(marked.mapInArrow(run, schema), "rlz-parsed")
        if proven(docs, out.select(F.explode("cells").alias("c")).select("c.*")):
            return out.drop("cells")
    raise RuntimeError(f"factors that their references' words refute, with each of {TRIES} hashes")


def removal_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs."""

    def make(text: bytes, words: list[bytes], gone: np.ndarray) -> tuple:
        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
        return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    fields = [("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string())]
    return parsed(docs.select("doc_id", "text"), make, fields, window, gram).select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def remove_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with duplicate words taken out of text; texts without any stay as they are, a text without a word left goes.

    Where something was removed, kept words keep the white space before them.
    """

    def make(text: bytes, words: list[bytes], gone: np.ndarray) -> tuple:
        if not gone.any():
            return None, False
        edge = np.diff((~_SPACE[np.frombuffer(text, np.uint8)]).astype(np.int8), prepend=0, append=0)
        ends = np.flatnonzero(edge == -1)
        lead = np.append(0, ends[:-1])
        left = b"".join(text[lead[i] : ends[i]] for i in np.flatnonzero(~gone))
        return left.decode().strip(" \t\n\x0b\x0c\r") or None, True

    out = parsed(docs, make, [("text", "string", pa.string()), ("cut", "boolean", pa.bool_())], window, gram).where("text is not null or not cut")
    return out.select(*row_columns(docs.columns))
