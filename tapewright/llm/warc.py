"""WARC archives with a two-level capture index.

Captures are written as WARC records, each a gzip member of its own, so that a record can be read by its byte range. A payload that an
earlier archive row has as well is written once, as the response of its largest page_id; the others are revisit records that
name it.

The index sorts captures by key (the URL with its host's labels reversed, then page_id) over all tasks. Runs of
BLOCK_LINES lines are compressed into blocks, and a sparse directory holds the first key and the byte range of every
block. A lookup finds the index part by its first key, binary-searches that part's directory, decompresses one block, binary-
searches its lines and reads the record's range.

Files lie in the folder shared by driver and executors and are opened through pyarrow's file systems. A task that runs again writes
new files under names of its own; only the files named by successful tasks are read.

Null html counts as empty, and null or odd URLs have the key of an empty host. Rows that repeat a page_id with the same payload are all
written like it. Rows with a null page_id are responses unless another row has their payload. Empty tables give empty archives and
results; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import slices, stored, work_dir

BLOCK_LINES = 1000
FILE_BYTES = 1 << 30
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sortable key of a URL: reversed host labels, then port, path and query; scheme, user and fragment are dropped."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*@)?", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?:]*", 0))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.substr(rest, F.length(host) + 1))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def open_store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP headers and leaves the payload out."""
    target = re.sub(r"[\x00-\x20\x7f]", "%20", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}"]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Type, target, page_id, refers_to, digest and payload (of a revisit: its size) of a WARC record; checks its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (base32_sha1(payload) != digest or len(payload) != size):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    page = lambda name: None if (x := fields[name][len("<urn:page:") : -1]) == "None" else int(x)
    return {"kind": kind, "page_id": page("WARC-Record-ID"), "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "digest": digest, "size": size, "payload": payload}


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def with_duplicates(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to and revisit, from digests alone: payloads are not grouped."""
    slim = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    repeated = stored(slim.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first"), "warc-repeated")
    again = slim.join(repeated, "sha").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_id"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
    own = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha"))
    joined = own.join(again, own.page_id.eqNullSafe(F.col("_id")) & (own.sha == F.col("_sha")), "left")
    return joined.select("page_id", "url", "html", "refers_to", F.col("_sha").isNotNull().alias("revisit"))


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every row of pages as a record; returns key, page_id, file, offset, length of each, from the shared folder."""
    uri = work_dir(pages.sparkSession, "warc")
    rows = with_duplicates(pages).withColumn("key", F.concat(url_key(F.col("url")), F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(uri)
        fs.create_dir(root, recursive=True)
        context, out, number, at, name = TaskContext.get(), None, 0, 0, ""
        for batch in batches:
            for b in slices(iter([batch]), "html"):
                places = []
                for key, page, url, html, refers, revisit in zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "url", "html", "refers_to", "revisit")), strict=True):
                    if out is None or at > FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{number}.warc.gz"
                        out, number, at = fs.open_output_stream(name, compression=None), number + 1, 0
                    member = gzip_member(record_bytes(page, url, (html or "").encode(), refers, revisit))
                    out.write(member)
                    places.append((key, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, "key string, file string, offset long, length long"), "warc-captures")


def build_index(captures: DataFrame, lines: int = BLOCK_LINES) -> tuple[str, list[tuple[str, str]]]:
    """Write the two-level index of captures; returns the folder's URI and (first key, part name) of every part.

    A part is one range of the sort, so the list has a row for each task, whatever the number of captures.
    """
    uri = work_dir(captures.sparkSession, "warc-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(uri)
        fs.create_dir(root, recursive=True)
        context, waiting, directory, at, name, out = TaskContext.get(), [], [], 0, "", None

        def flush(most: int) -> None:
            nonlocal at, waiting
            while waiting and len(waiting) >= most:
                first = waiting[0].split("\t", 1)[0]
                block = zlib.compress("\n".join(waiting[:lines]).encode(), 6)
                out.write(block)
                directory.append(f"{first}\t{at}\t{len(block)}")
                at += len(block)
                waiting = waiting[lines:]

        for b in batches:
            if b.num_rows and out is None:
                name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
                out = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
            waiting += [f"{k}\t{f}\t{o}\t{n}" for k, f, o, n in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True)]
            flush(lines)
        if out is not None:
            flush(1)
            out.close()
            with fs.open_output_stream(f"{root}/{name}.dir", compression=None) as f:
                f.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([name])], ["first", "part"])

    ordered = captures.repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    parts = stored(ordered.mapInArrow(run, "first string, part string"), "warc-parts")
    return uri, sorted(((r["first"], r["part"]) for r in parts.collect()), key=lambda p: (p[0].encode(), p[1]))


class IndexReader:
    """Lookups in one index: keeps the last part's directory, the last block and the last archive open."""

    def __init__(self, uri: str, parts: list[tuple[str, str]]) -> None:
        self.fs, self.root = open_store(uri)
        self.firsts, self.names = [p[0].encode() for p in parts], [p[1] for p in parts]
        self.part = self.block = -1
        self.archive, self.opened = None, ""

    def load(self, part: int, block: int) -> None:
        if part != self.part:
            with self.fs.open_input_file(f"{self.root}/{self.names[part]}.dir") as f:
                entries = [line.split(b"\t") for line in f.read().split(b"\n")]
            self.heads = [e[0] for e in entries]
            self.ranges = [(int(e[1]), int(e[2])) for e in entries]
            self.part, self.block = part, -1
        if block >= 0 and block != self.block:
            at, n = self.ranges[block]
            with self.fs.open_input_file(f"{self.root}/{self.names[part]}.cdx") as f:
                f.seek(at)
                self.lines = zlib.decompress(f.read(n)).split(b"\n")
            self.keys = [x.split(b"\t", 1)[0] for x in self.lines]
            self.block = block

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """file, offset and length of every capture with this key."""
        want = key.encode()
        # equal keys may run over from the block or part before the first that starts with them
        part = max(0, bisect.bisect_left(self.firsts, want) - 1)
        while part < len(self.names) and self.firsts[part] <= want:
            self.load(part, -1)
            block = max(0, bisect.bisect_left(self.heads, want) - 1)
            while block < len(self.heads) and self.heads[block] <= want:
                self.load(part, block)
                i = bisect.bisect_left(self.keys, want)
                while i < len(self.keys) and self.keys[i] == want:
                    _, file, offset, length = self.lines[i].split(b"\t")
                    yield file.decode(), int(offset), int(length)
                    i += 1
                block += 1
            part += 1

    def record(self, file: str, offset: int, length: int) -> bytes:
        if file != self.opened:
            if self.archive is not None:
                self.archive.close()
            self.archive, self.opened = self.fs.open_input_file(file), file
        self.archive.seek(offset)
        return zlib.decompress(self.archive.read(length), 31)


def lookup(keys: DataFrame, uri: str, parts: list[tuple[str, str]]) -> DataFrame:
    """The captures of every distinct key: key, page_id, payload_bytes, payload_digest, record_type, refers_to.

    Keys are resolved to places in their own order, so that each index block is read once; then the places are read in the order of the
    archives, so that each file is opened by few tasks.
    """

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(uri, parts)
        for b in batches:
            rows = [(key, *place) for key in b.column("key").to_pylist() for place in reader.find(key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = IndexReader(uri, [])
        for b in batches:
            rows = []
            for key, *place in zip(*(b.column(c).to_pylist() for c in ("key", "file", "offset", "length")), strict=True):
                r = parse_record(reader.record(*place))
                rows.append((key, r["page_id"], r["size"], r["digest"], r["kind"], r["refers_to"]))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    places = stored(ordered.mapInArrow(resolve, "key string, file string, offset long, length long"), "warc-places")
    # a stated number of partitions is not coalesced: the rows are small, the records behind them are not
    by_file = places.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return by_file.mapInArrow(read, "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_report(pages: DataFrame) -> DataFrame:
    """Write pages as archives, index them, and look every capture up again."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    uri, parts = build_index(write_archives(pages))
    wanted = pages.select(F.concat(url_key(F.col("url")), F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit("-"))).alias("key"))
    return lookup(wanted, uri, parts).drop("key")
