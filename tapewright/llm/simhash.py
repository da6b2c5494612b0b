"""SimHash near-duplicate groups with pigeonring candidate filtering.

Fingerprints of 64 bits are cut into four 16-bit segments on a ring. Two fingerprints within tau = 2 bits have, by the
pigeonring principle, a start from which every chain of l consecutive segments differs in at most l * tau / 4 bits:
none in the first segment, at most one over the first two and over the first three, at most two in all. Such a chain
leaves at least two segments equal, so candidates meet on pairs of equal segments; the chain condition prunes them before the
full Hamming check.

Documents are first collapsed to distinct fingerprints, so exact copies never pair up. A bucket emits a spanning star of
its groups, not all its pairs. A bucket above BUCKET_ROWS is dealt again by two equal bytes of its other 32 bits (four
bytes, at most two of them differ), which leaves at most 2 ** 16 fingerprints in any bucket.

near_duplicate_classes serves similarities that few differing bits cannot express (a Jaccard similarity of 0.8 on shingles of five
words leaves about 10 of 64 bits different, so no segment need be equal). There candidates meet on bands of least shingle
hashes; the pigeonring chains with a budget of WIDE_TAU bits, the full Hamming check and a sketch of SKETCH least hashes with
a margin of several deviations prune them, and the exact similarity of the sets of shingles decides. keep_one leaves one
document of each class.

Null text counts as empty, and empty texts have fingerprint 0 and link like any other. Repeated rows and rows with a
null doc_id keep their own result row; a component of rows with null ids only has a null component_id. An empty table
gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tapewright.llm.common import WORD_PATTERN, bit_map, by_bit_map, row_but_text, row_columns, slices, splitmix, stored, utf8_rows
from tapewright.llm.substring import rolling, word_hashes

TAU = 2
SEGMENTS = 4
SEED = 42
SHINGLE = 3
BUCKET_ROWS = 20_000
#: Rows of a bucket compared in one block.
BLOCK = 1024
#: Least hashes in a sketch (one byte each is kept), bands that candidates meet on, and least hashes in a band.
SKETCH, BANDS, BAND = 128, 16, 4
#: Bits that fingerprints of texts with a similarity of 0.8 differ in, four standard deviations above the mean.
WIDE_TAU = 22
#: Rounds after which components give up; they grow with the logarithm of the longest chain.
ROUNDS = 60
#: Shingles of a loose class compared in one task (8 bytes each).
CLASS_SHINGLES = 8_000_000

_MULTIPLIERS = splitmix(np.arange(7000, 7000 + SKETCH, dtype=np.uint64)) | np.uint64(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(words: list[bytes], size: int = SHINGLE) -> int:
    """Fingerprint of a word sequence: a bit is set if it is set in over half the shingle hashes."""
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words) - size + 1
    if n < 1:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter((digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(size)), strict=False)), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 16_000_000):
            fp = np.array([simhash(x.lower().split(), size) for x in utf8_rows(b.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def ring_close(x: np.ndarray, tau: int = TAU, m: int = SEGMENTS) -> np.ndarray:
    """Whether XORed fingerprints pass the pigeonring test: a start whose chains all stay within l * tau / m bits."""
    seg = np.stack([np.bitwise_count((x >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int16) for i in range(m)])
    passed = np.zeros(x.shape, bool)
    for start in range(m):
        run, ok = np.zeros(x.shape, np.int16), np.ones(x.shape, bool)
        for length in range(1, m + 1):
            run = run + seg[(start + length - 1) % m]
            ok &= run * m <= length * tau
        passed |= ok
    return passed


def bucket_links(fps: np.ndarray, tau: int = TAU) -> list[tuple[int, int]]:
    """A spanning star for each connected group of distinct fingerprints of one bucket, in blocks."""
    n = len(fps)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return int(i)

    for a in range(0, n, BLOCK):
        left = fps[a : a + BLOCK]
        for b in range(a, n, BLOCK):
            x = left[:, None] ^ fps[None, b : b + BLOCK]
            i, j = np.nonzero(ring_close(x, tau))
            keep = i + a < j + b
            i, j = i[keep], j[keep]
            x = x[i, j]
            close = np.bitwise_count(x) <= tau
            for p, q in zip(i[close] + a, j[close] + b, strict=True):
                p, q = root(int(p)), root(int(q))
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return [(int(fps[i]), int(fps[r])) for i in range(n) if (r := root(i)) != i]


def _keys(df: DataFrame) -> DataFrame:
    """One row for each fingerprint and pair of equal segments: key (32 bits of segments and the pair's number)."""
    seg = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(SEGMENTS)]
    keys = [F.shiftleft(seg[i], 16).bitwiseOR(seg[j]).bitwiseOR(F.lit(n << 32)) for n, (i, j) in enumerate(combinations(range(SEGMENTS), 2))]
    return df.select("fp", F.explode(F.array(*keys)).alias("key"), F.lit(0).alias("sub"))


def _subkeys(df: DataFrame) -> DataFrame:
    """Deal hot buckets again: of the four bytes outside the bucket's segments at least two are equal."""
    pairs = list(combinations(range(SEGMENTS), 2))
    rest = [[i for i in range(SEGMENTS) if i not in p] for p in pairs]
    word = F.element_at(
        F.array(*[F.shiftleft(F.shiftrightunsigned("fp", 16 * a).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftrightunsigned("fp", 16 * b).bitwiseAND(F.lit(0xFFFF))) for a, b in rest]),
        (F.shiftrightunsigned("key", 32) + 1).cast("int"),
    )
    octet = [F.shiftrightunsigned(word, 8 * i).bitwiseAND(F.lit(0xFF)) for i in range(4)]
    subs = [(F.shiftleft(octet[i], 8).bitwiseOR(octet[j]) + F.lit(1 + (n << 16))).cast("int") for n, (i, j) in enumerate(pairs)]
    return df.select("fp", "key", F.explode(F.array(*subs)).alias("sub"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges a, b between distinct fingerprints, enough to connect each bucket's groups."""
    keyed = _keys(distinct)
    hot = keyed.groupBy("key").count().where(F.col("count") > BUCKET_ROWS).select("key")
    hot = stored(hot, "simhash-hot")
    if hot.limit(1).count():
        keyed = keyed.join(hot, "key", "left_anti").unionByName(_subkeys(keyed.join(hot, "key", "left_semi")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        rest = None  # the rows of the bucket that the next batch may continue
        for b in batches:
            k = np.stack([b.column("key").to_numpy(), b.column("sub").to_numpy().astype(np.int64)])
            f = b.column("fp").to_numpy().view(np.uint64)
            if rest is not None:
                k, f = np.concatenate([rest[0], k], axis=1), np.concatenate([rest[1], f])
            edges_at = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            edges_at = np.concatenate([[0], edges_at])
            found: list[tuple[int, int]] = []
            for s, e in zip(edges_at[:-1], edges_at[1:], strict=True):
                if e - s > 1:
                    found += bucket_links(f[s:e])
            rest = k[:, edges_at[-1] :], f[edges_at[-1] :]
            if found:
                yield out(found)
        if rest is not None and len(rest[1]) > 1 and (found := bucket_links(rest[1])):
            yield out(found)

    dealt = keyed.repartition("key", "sub").sortWithinPartitions("key", "sub", "fp")
    # rows of single-row buckets never link; the sort keeps a bucket's rows together
    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of an edge list a, b: star contraction until no edge changes.

    Alternates large-star and small-star steps; each step is two shuffles, its result is written to the shared
    folder, and the number of steps grows with the logarithm of the longest chain. The least neighbours are written out
    before they meet the edges, so that the join has a plain exchange on either side and a hub's edges can be split.
    """
    edges = stored(edges.where("a <> b"), "components")
    last = None
    for _ in range(ROUNDS):
        if last is None and not edges.limit(1).count():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "components-low")
        # large star: link every larger neighbour to the least of the neighbourhood
        large = stored(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "components-large")
        # small star: link smaller neighbours and the node itself to the least of them
        down = stored(large.groupBy("a").agg(F.min("b").alias("m")), "components-down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = stored(small, "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
    raise RuntimeError(f"components are not done after {ROUNDS} rounds")


def near_duplicate_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row of docs."""
    prints = stored(fingerprints(docs, size), "simhash-fp")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp")))
    labelled = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    # written out, so that the join below has a plain exchange on either side and a hot fingerprint can be split
    ids = stored(labelled.join(least, "root").select("fp", "component_id"), "simhash-ids")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of every size consecutive words; fewer words than size count as one shingle."""
    return np.unique(rolling(words, min(size, len(words)), 0x9E3779B97F4A7C15))


def content_hash(lowered: bytes) -> bytes:
    """128 bits that stand for a text's words."""
    return xxhash.xxh3_128_digest(b" ".join(lowered.split()), SEED)


def sketch(words: np.ndarray, size: int) -> tuple[int, bytes, np.ndarray]:
    """Fingerprint, least-hash bytes and bands of a sequence of word hashes."""
    hashes = shingles(words, size)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    fp = int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):  # small enough for the cache
        part = hashes[at : at + 512, None] * _MULTIPLIERS[None, :]
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    least = splitmix(least)
    bands = least[: BANDS * BAND].reshape(BANDS, BAND)
    keys = splitmix(np.arange(BANDS, dtype=np.uint64))
    for i in range(BAND):
        keys = splitmix(keys ^ bands[:, i])
    return fp, least.astype(np.uint8).tobytes(), keys


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, content (128-bit hash of the lower-cased words), fp, sig, bands of each row of docs that has a word."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "content", "fp", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, "text"):
                at, rows = [], []
                for i, text in enumerate(utf8_rows(b.column("text"))):
                    lowered = text.lower()
                    words = word_hashes(lowered)
                    if len(words):
                        at.append(i)
                        rows.append((content_hash(lowered), *sketch(words, size)))
                contents, sigs = (pa.array([r[j] for r in rows], pa.binary()) for j in (0, 2))
                fps = pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))
                bands = pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), contents, fps, sigs, bands], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, content binary, fp long, sig binary, bands array<long>")


def estimate_floor(similarity: float) -> float:
    """The share of equal sketch bytes below which a pair is dropped: 4.25 standard deviations under the similarity (0.65 at 0.8)."""
    low = similarity - 4.25 * (similarity * (1 - similarity) / SKETCH) ** 0.5
    return low + (1 - low) / 256  # different hashes share a byte now and then


def group_links(group: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links of one group: a search from each row over those not yet reached, so a class costs its size and not its pairs.

    Fingerprints and sketches only prune. Where the group has shingles, their exact similarity decides.
    """
    ids, fps = group["no"].to_numpy(), group["fp"].to_numpy().view(np.uint64)
    sigs = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(-1, SKETCH)
    floor, exact = estimate_floor(similarity), "shingles" in group.column_names
    if exact:
        sets = group["shingles"].to_pylist()
        sizes = np.array([len(x) // 8 for x in sets])
        starts = np.cumsum(sizes) - sizes
        values, codes = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
        mark = np.zeros(len(values), bool)
        del sets, values

    def jaccard(i: int, rows: np.ndarray) -> np.ndarray:
        mine = codes[starts[i] : starts[i] + sizes[i]]
        mark[mine] = True
        n = sizes[rows]
        before = np.cumsum(n) - n
        common = np.add.reduceat(mark[codes[np.arange(n.sum()) + np.repeat(starts[rows] - before, n)]], before, dtype=np.int64)
        mark[mine] = False
        return common / (sizes[i] + n - common)

    waiting, out = np.arange(len(ids)), []
    while len(waiting) > 1:
        frontier, waiting = [int(waiting[0])], waiting[1:]
        while frontier and len(waiting):
            i = frontier.pop()
            x = fps[waiting] ^ fps[i]
            near = np.flatnonzero(np.bitwise_count(x) <= WIDE_TAU)
            near = near[ring_close(x[near], WIDE_TAU)]
            near = near[(sigs[waiting[near]] == sigs[i]).mean(axis=1) >= floor]
            if exact and len(near):
                near = np.concatenate([part[jaccard(i, waiting[part]) >= similarity] for part in np.split(near, range(BLOCK, len(near), BLOCK))])
            out += [(int(ids[i]), int(ids[j])) for j in waiting[near]]
            frontier += waiting[near].tolist()
            waiting = np.delete(waiting, near)
    return out


def links_by(dealt: DataFrame, key: str, similarity: float) -> DataFrame:
    """Distinct links a, b of each group of rows with one key and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the group that the next batch may continue
        for b in batches:
            rest = pa.table(b) if rest is None else pa.concat_tables([rest, pa.table(b)])
            k = np.stack([rest[key].to_numpy(), rest["part"].to_numpy()])
            edges = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1])
            found = {x for s, e in zip(edges[:-1], edges[1:], strict=True) if e - s > 1 for x in group_links(rest.slice(s, e - s), similarity)}
            rest = rest.slice(edges[-1])
            yield pairs(found)
        if rest is not None and rest.num_rows > 1:
            yield pairs(set(group_links(rest, similarity)))

    def pairs(found: set[tuple[int, int]]) -> pa.RecordBatch:
        e = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

    return dealt.repartition(key, "part").sortWithinPartitions(key, "part", "no").mapInArrow(run, "a long, b long").distinct()


def _parts(n: Column, most: int) -> Column:
    """Parts of which any two hold about most of n."""
    return F.when(n <= most, F.lit(1).cast("long")).otherwise(F.ceil(n * 2 / most))


def in_pairs(df: DataFrame, key: str) -> DataFrame:
    """no, key, part: rows of df (no, key, parts) once for each pair of parts that theirs is in, so any two rows of a key meet."""
    own, zero = F.pmod(F.xxhash64("no"), F.col("parts")), F.lit(0).cast("long")
    others = F.when(F.col("parts") == 1, F.array(zero)).otherwise(F.filter(F.sequence(zero, F.col("parts") - 1), lambda q: q != own))
    return df.select("no", key, F.explode(F.transform(others, lambda q: F.least(own, q) * F.col("parts") + F.greatest(own, q))).alias("part"))


def shingle_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """no, class, n (distinct shingles) and shingles (their sorted hashes) of each row of members (no, content, first, class)."""
    wanted = members.select(F.col("first").alias("doc_id"), "no", "content", "class")
    # most texts are no members and need not be shuffled
    perhaps, _ = by_bit_map(docs, bit_map(wanted, "doc_id"), "doc_id")
    asked = perhaps.join(wanted, "doc_id").select("no", "content", "class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, "text"):
                at, sets = [], []
                for i, (text, content) in enumerate(zip(utf8_rows(b.column("text")), b.column("content").to_pylist(), strict=True)):
                    lowered = text.lower()
                    words = word_hashes(lowered)
                    # rows of one doc_id may have different texts
                    if len(words) and content_hash(lowered) == content:
                        at.append(i)
                        sets.append(shingles(words, size))
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("no").take(take), b.column("class").take(take), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["no", "class", "n", "shingles"])

    return asked.mapInArrow(run, "no long, class long, n long, shingles binary").dropDuplicates(["no"])


def classed_texts(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The doc_id and content of every row of docs that has both, and content, first (smallest doc_id), keeper, keeper_content, members
    of every text: its class's text with the smallest doc_id, and the class's number of (doc_id, content).

    Exact copies are collapsed first, and everything after has one row for each text; only texts that share a band with another text are
    compared. Texts that may be similar by their sketches form loose classes, so that every link lies in one of these. Then each
    loose class is searched again by the exact similarity of its shingle sets. A band or loose class too large for one task is
    cut into parts, and every two parts meet in a task of their own.
    """
    docs = docs.where("doc_id is not null").select("doc_id", "text")
    known = stored(sketches(docs, size), "near-sketches")
    ids = known.select("doc_id", "content").distinct()
    # a text's number is fixed once it is written, and only tells texts apart; no result depends on it
    numbered = ids.groupBy("content").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id())
    texts = stored(numbered, "near-texts")
    # one row of each text; both columns are hashed, so copies of one text are dealt out
    single = known.join(texts.select("content", F.col("first").alias("doc_id"), "no"), ["content", "doc_id"]).dropDuplicates(["content", "doc_id"])
    single = stored(single.select("no", "fp", "sig", "bands"), "near-single")
    keys = single.select("no", F.explode("bands").alias("band")).distinct()
    shared = stored(keys.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "near-shared")
    met = stored(in_pairs(keys.join(shared, "band").select("no", "band", _parts(F.col("n"), BUCKET_ROWS).alias("parts")), "band"), "near-met")
    marks = stored(single.join(met.select("no").distinct(), "no", "left_semi").select("no", "fp", "sig"), "near-marks")
    loose = stored(components(links_by(met.join(marks, "no").select("no", "band", "part", "fp", "sig"), "band", similarity)), "near-loose")
    placed = texts.join(loose, texts.no == loose.node, "left").select("no", "content", "first", F.coalesce("root", "no").alias("class"))
    members = stored(placed.join(loose.select(F.col("root").alias("class")).distinct(), "class", "left_semi"), "near-members")
    sets = stored(shingle_sets(docs, members, size), "near-shingles")
    classes = sets.groupBy("class").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles_in"))
    parts = F.greatest(_parts(F.col("texts"), BUCKET_ROWS), F.least("texts", _parts(F.col("shingles_in"), CLASS_SHINGLES)))
    dealt = in_pairs(sets.select("no", "class").join(classes, "class").select("no", "class", parts.alias("parts")), "class")
    edges = links_by(dealt.join(sets.select("no", "shingles"), "no").join(marks, "no").select("no", "class", "part", "fp", "sig", "shingles"), "class", similarity)
    roots = components(edges)
    classed = texts.join(roots, texts.no == roots.node, "left").select("content", "first", "n", F.coalesce("root", "no").alias("root"))
    least = classed.groupBy("root").agg(F.min(F.struct("first", "content")).alias("k"), F.sum("n").alias("members"))
    named = classed.join(least, "root").select("content", "first", F.col("k.first").alias("keeper"), F.col("k.content").alias("keeper_content"), "members")
    return ids, stored(named, "near-classes")


def near_duplicate_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, content, keeper of each distinct (doc_id, content) of docs in a class of two or more; keeper: its smallest doc_id."""
    ids, texts = classed_texts(docs, size, similarity)
    # read from files on both sides, so that a text with very many copies can be split
    return stored(ids, "near-ids").join(texts.where("members > 1").select("content", "keeper"), "content").select("doc_id", "content", "keeper")


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each near-duplicate class, the one with the smallest doc_id (then the smallest hash of its words).

    Texts are told apart by doc_id and content (the lower-cased words), so different texts under one doc_id are judged one by one, and of rows
    that share both one stays. Rows with a null doc_id and texts without a word are no copies of anything and stay.
    An empty table gives an empty result; other columns are passed on.
    """
    ids, texts = classed_texts(docs, size, similarity)
    keep = stored(texts.where("content = keeper_content").select(F.col("first").alias("doc_id"), "content"), "near-keep")
    judged = F.col("doc_id").isNotNull() & F.coalesce(F.col("text").rlike(WORD_PATTERN), F.lit(False))
    rows = docs.select(row_but_text(docs), F.col("doc_id").alias("id"), "text", judged.alias("judged"))
    again = stored(rows.where("judged").groupBy("id").count().where("count > 1").select("id"), "near-again")
    # only rows whose id has a text that goes, or has several rows, need to meet what is kept
    gone = ids.join(keep, ["doc_id", "content"], "left_anti").select(F.col("doc_id").alias("id"))
    doubtful, others = by_bit_map(rows, bit_map(gone.unionByName(again), "id"), "id", also=F.col("judged"))
    kept = doubtful.join(keep.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    if again.limit(1).count():
        # only ids with several rows need their contents hashed
        many = with_content(doubtful.join(again, "id", "left_semi").select("row", "text", "id"))
        many = many.join(keep.withColumnRenamed("doc_id", "id"), ["id", "content"], "left_semi").dropDuplicates(["id", "content"])
        kept = kept.join(again, "id", "left_anti").select("row", "text").unionByName(many.select("row", "text"))
    return others.select("row", "text").unionByName(kept.select("row", "text")).select(*row_columns(docs.columns))


def with_content(rows: DataFrame) -> DataFrame:
    """rows (row, text, id; with a word each) with content, the hash of the lower-cased words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            hashes = [content_hash(x.lower()) for x in utf8_rows(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hashes, pa.binary())], [*b.schema.names, "content"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("content", BinaryType())]))
