"""Media columns: content-defined payload chunking with a deduplicated chunk store.

A payload is a text's UTF-8 bytes with zero bytes appended up to a positive multiple of ALIGN, stored as 8-bit samples. A
rolling gear hash of the last 32 bytes cuts it into chunks (between LEAST and MOST bytes), so equal stretches give
equal chunks wherever they lie. Joins on chunk digests find chunks that occur more than once; such a chunk is stored once,
in a table keyed by digest, and a chunk of its own only document lies in that document's row. A document's recipe is its ordered list of
chunk lengths and digests; its media form is the recipe followed by the chunks it names.

Reading fetches shared chunks by a join on digests, puts every payload together by its recipe and verifies each chunk and
the length. Only metadata and shared chunks are shuffled: the list of a document's shared chunks meets the text by a
broadcast where a count shows it to be small, else by a shuffle.

Null text counts as empty: 64 zero bytes. Repeated rows share all chunks and keep a row each; null ids are kept. An empty
table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import slices, splitmix, stored, text_hash, utf8_rows, work_dir

ALIGN = 64
REACH = 32
LEAST, MOST = 1024, 16_384
#: A cut is made where this many bits of the hash are zero.
CUT_BITS = 12
#: Bytes of shared-chunk lists, as counted, up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
#: References to one shared chunk that meet it in one copy.
REFERENCES = 2000

_OWNED = pa.list_(pa.struct([("digest", pa.binary()), ("n_refs", pa.int64()), ("data", pa.binary())]))
_GEAR = (splitmix(np.arange(4096, 4096 + 256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def payload_of(text: bytes) -> bytes:
    return text + bytes((-len(text)) % ALIGN or (0 if text else ALIGN))


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last REACH bytes asks for a cut.

    The hash of a place is the sum of gear values, each doubled once for each byte it lies behind; sums over 1, 2, 4 ..
    bytes are put together in 5 steps over the whole array.
    """
    h = _GEAR[data]
    size = 1
    while size < REACH:
        h[size:] = h[size:] + (h[:-size] << np.uint32(size))
        size *= 2
    return np.flatnonzero((h >> np.uint32(32 - CUT_BITS)) == 0) + 1


def chunk_ends(size: int, cuts: np.ndarray) -> list[int]:
    """Ends of the chunks of a payload, given the places where a cut is asked for."""
    out, start = [], 0
    for c in cuts.tolist():
        while c - start > MOST:
            start += MOST
            out.append(start)
        if c - start >= LEAST and c < size:
            out.append(c)
            start = c
    while size - start > MOST:
        start += MOST
        out.append(start)
    out.append(size)
    return out


def chunked(payloads: list[bytes]) -> list[list[bytes]]:
    """The chunks of each payload; one hash pass over all of them."""
    if not payloads:
        return []
    cuts = gear_cuts(np.frombuffer(b"".join(payloads), np.uint8))
    starts = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    edges = np.searchsorted(cuts, starts)
    out = []
    for i, p in enumerate(payloads):
        own = cuts[edges[i] : edges[i + 1]] - starts[i]
        ends = chunk_ends(len(p), own[own >= REACH])  # before, the hash reaches into the payload ahead
        out.append([p[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()


def recipe_of(n_bytes: int, chunks: list[tuple[int, bytes]]) -> bytes:
    """A document's ordered chunk list: unpadded size, then length and digest of each chunk."""
    return b"CDC1" + struct.pack("<QI", n_bytes, len(chunks)) + b"".join(struct.pack("<I", n) + d for n, d in chunks)


def read_recipe(recipe: bytes) -> tuple[int, list[tuple[int, bytes]]]:
    n_bytes, n = struct.unpack_from("<QI", recipe, 4)
    return n_bytes, [(struct.unpack_from("<I", recipe, 16 + 36 * i)[0], recipe[20 + 36 * i : 52 + 36 * i]) for i in range(n)]


def features(payload: bytes, n_chunks: int) -> str:
    """Level statistics of the 8-bit samples of a payload."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    crossings = int(np.count_nonzero(np.diff((x >= 128).view(np.int8))))
    return f"samples={len(x)};chunks={n_chunks};mean={(counts @ np.arange(256)) / len(x):.4f};peak={int(x.max())};entropy={-(p * np.log2(p)).sum():.4f};crossings={crossings}"


def chunk_index(docs: DataFrame) -> DataFrame:
    """doc_id, th, seq, digest of every chunk of docs (doc_id, text, th); no payloads."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            parts = chunked([payload_of(x) for x in utf8_rows(b.column("text"))])
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(p) for p in parts]))
            seq = pa.array(np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), seq, pa.array([digest(c) for p in parts for c in p], pa.binary())], ["doc_id", "th", "seq", "digest"])

    return docs.mapInArrow(run, f"doc_id {kind}, th long, seq int, digest binary")


def ingest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store docs: (document rows, shared chunks, references to shared chunks), all read from the shared folder.

    Document rows: doc_id, th, n_shared, recipe, data (its unshared chunks in order); the shared chunks a document is the first to
    have lie in a column of their own, which reading documents skips. Shared chunks: digest, n_refs, data.
    References: doc_id, th, seq, digest, n_refs.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", text_hash().alias("th"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    index = stored(chunk_index(docs), "chunk-index")
    shared = index.groupBy("digest").agg(F.count("*").alias("n_refs"), F.min(F.struct("th", "doc_id", "seq")).alias("owner")).where("n_refs > 1")
    shared = stored(shared, "chunk-shared")
    refs = index.join(shared, "digest").select("doc_id", "th", "seq", "digest", "n_refs", ((F.col("owner.th") == F.col("th")) & F.col("owner.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("owner.seq") == F.col("seq"))).alias("own"))
    refs = stored(refs, "chunk-refs")
    lists = refs.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "seq", "own", "n_refs").distinct().groupBy("_id", "_th").agg(F.collect_list(F.struct("seq", "own", "n_refs")).alias("shared"))
    lists = stored(lists, "chunk-lists")
    if (lists.agg(F.sum(F.size("shared") * 40 + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        lists = F.broadcast(lists)
    known = docs.join(lists, docs.doc_id.eqNullSafe(F.col("_id")) & (docs.th == F.col("_th")), "left").select("doc_id", "th", "text", "shared")
    store = work_dir(spark, "media-store")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n_shared", "recipe", "data", "owned"]
        for b in slices(batches, "text"):
            texts = utf8_rows(b.column("text"))
            rows = []
            for text, parts, common in zip(texts, chunked([payload_of(x) for x in texts]), b.column("shared").to_pylist(), strict=True):
                named = {s["seq"]: s for s in common or ()}
                listed = [(len(p), digest(p)) for p in parts]
                owned = [{"digest": listed[j][1], "n_refs": s["n_refs"], "data": parts[j]} for j, s in named.items() if s["own"]]
                rows.append((len(named), recipe_of(len(text), listed), b"".join(p for j, p in enumerate(parts) if j not in named), owned))
            own = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), _OWNED))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), *own], names)

    schema = f"doc_id {kind}, th long, n_shared int, recipe binary, data binary, owned array<struct<digest: binary, n_refs: bigint, data: binary>>"
    known.mapInArrow(run, schema).write.option("compression", "zstd").parquet(store)
    back = spark.read.schema(schema).parquet(store)
    # repeated rows own the same chunk, so it may be there more than once
    chunks = back.select(F.explode("owned").alias("c")).select("c.*").dropDuplicates(["digest"])
    return back.drop("owned"), chunks, refs


def _verified(recipe: bytes, data: bytes, fetched: dict[int, bytes]) -> tuple:
    """Put a payload together, verify it and describe it."""
    n_bytes, listed = read_recipe(recipe)
    parts, at = [], 0
    for i, (n, d) in enumerate(listed):
        if i in fetched:
            part = fetched[i]
        else:
            part = data[at : at + n]
            at += n
        if len(part) != n or digest(part) != d:
            raise ValueError(f"chunk {i} of a payload does not match its digest")
        parts.append(part)
    payload = b"".join(parts)
    if at != len(data) or len(payload) != n_bytes + ((-n_bytes) % ALIGN or (0 if n_bytes else ALIGN)):
        raise ValueError("a payload does not have the size its recipe gives")
    return (
        n_bytes,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-ALIGN:]),
        len(recipe) + len(payload),
        hashlib.sha256(recipe + payload).hexdigest(),
        features(payload, len(listed)),
    )


_OUT = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def read_media(rows: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id and the verified payload's sizes, digests and features, for every stored document row."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "data"):
            out = [_verified(r, d, {}) for r, d in zip(b.column("recipe").to_pylist(), b.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES))], ["doc_id", *_OUT])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.append(batch.column("size").to_numpy().cumsum() // 4_000_000, -1)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(ends)) + 1])
            for j, k in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                b = batch.slice(j, k - j)
                at, out = [], []
                for i, parts in enumerate(b.column("parts").to_pylist()):
                    fetched = {p["seq"]: p["data"] for p in parts if p["seq"] >= 0}
                    for p in parts:
                        if p["seq"] < 0:
                            at.append(i)
                            out.append(_verified(p["recipe"], p["data"], fetched))
                place = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(place), *(pa.array([o[i] for o in out], t) for i, t in enumerate(_TYPES))], ["doc_id", *_OUT])

    direct = rows.where("n_shared = 0").select("doc_id", "recipe", "data").mapInArrow(alone, schema)
    # a chunk with many references is copied once for each REFERENCES of them, so no task meets all
    copies = F.ceil(F.col("n_refs") / REFERENCES)
    many = chunks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).select("digest", "salt", "data")
    wanted = refs.select("doc_id", "th", "seq", "digest", "n_refs").distinct().withColumn("salt", F.pmod(F.xxhash64("th", "doc_id"), copies)).drop("n_refs")
    fetched = wanted.join(many, ["digest", "salt"]).select("doc_id", "th", F.struct("seq", F.lit(None).cast("binary").alias("recipe"), "data").alias("p"))
    own = rows.where("n_shared > 0").select("doc_id", "th", F.struct(F.lit(-1).alias("seq"), "recipe", "data").alias("p"))
    whole = own.unionByName(fetched).groupBy("doc_id", "th").agg(F.collect_list("p").alias("parts"), F.sum(F.length("p.data")).alias("size")).select("doc_id", "parts", "size")
    return direct.unionByName(whole.mapInArrow(assembled, schema))


def media_report(docs: DataFrame) -> DataFrame:
    """Store every text of docs as media, read it back and describe it."""
    return read_media(*ingest(docs))
