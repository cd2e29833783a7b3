"""WARC archives of pages with a two-level capture index.

``write_archives`` writes one gzip member per record into ``*.warc.gz`` shards and returns the capture entries;
``write_index`` sorts the entries by reversed-host URL key (range partitions, so one hot host or URL is spread) and packs
them into compressed blocks, with a sparse directory of the blocks beside each index file and one file that names the
index files with their first and last keys. Both are sorted and end with a table of offsets, so ``lookup`` bisects them
by a few small range reads without Spark, reads the blocks that hold the key one by one, bisects those, and range-reads
the records; ``read_archives`` reads every block and then every record by its range. A revisit's size and digest are
those that the response it refers to was read back with.

A record whose payload has at least ``min_dedup_bytes`` bytes and equals that of a smaller ``page_id`` is a revisit
without payload; others are responses. Defined results: a null html is an empty payload; a null url has the key ``)/``;
a null ``page_id`` is always a response and is referred to by none; repeated rows each get a record (copies of the row
with the smallest id are all responses); an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_folder, filesystem, parallelism, publish, shared_folder, staged

MIN_DEDUP_BYTES = 100
BLOCK_ENTRIES = 1024
DATE = "2024-01-01T00:00:00Z"
ENTRY = "surt string, page_id long, url string, digest string, record_type string, archive string, start long, length long"
DIRECTORY = "first_key string, last_key string, index_file string, start long, length long, entries int"
#: Names of the files that lookups bisect.
SPARSE, TOP = ".sparse", "index-files"
_WIRE = re.compile("[\x00-\x20\x7f]")


def surt(url: str | None) -> str:
    """Reversed-host key: host labels in reverse, ``)``, then path and query; ports, user names and fragments go."""
    try:
        parts = urlsplit(url or "")
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return f"){url}"
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}){parts.path or '/'}{query}"


def classify(pages: DataFrame, min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """page_id, digest and the first page with the same payload, one row per (page_id, digest); html is not carried."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("bytes")).filter(F.col("page_id").isNotNull()).distinct()
    keys = staged(keys, "warc-digests")
    firsts = keys.filter(F.col("bytes") >= min_dedup_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return keys.join(firsts, "digest", "left").select("page_id", "digest", F.when(F.col("first_id") < F.col("page_id"), F.col("first_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_WIRE.sub(lambda m: quote(m.group()), url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields; the payload's size and digest are computed for responses and taken from the header for revisits."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) and int(m[1])
    out = {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:")}
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


def write_archives(pages: DataFrame, folder: str, min_dedup_bytes: int = MIN_DEDUP_BYTES, level: int = 3) -> DataFrame:
    """Write all pages below ``folder``; return the capture entries (staged, from successful attempts only)."""
    ensure_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, fs, name = None, 0, None, ""
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = filesystem(name)
                    out = fs.open_output_stream(path + ".tmp")
                payload = (html or "").encode("utf-8", "replace")
                digest = hashlib.sha256(payload).hexdigest()
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                out.write(member)
                rows.append((surt(url), page_id, url, digest, "response" if refers_to is None else "revisit", name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])
        if out is not None:
            out.close()
            publish(fs, path + ".tmp", path)

    kinds = classify(pages, min_dedup_bytes)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", F.sha2(F.encode(F.coalesce("html", F.lit("")), "UTF-8"), 256))
    typed = rows.join(kinds, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")
    return staged(typed.mapInArrow(write, ENTRY), "warc-entries")


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Sort the entries into compressed blocks below ``folder``; return the sparse directory, a row per block."""
    ensure_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out, at, fs, name, blocks = None, 0, None, "", []
        for batch in itertools.chain(batches, [None]):
            held += zip(*(c.to_pylist() for c in batch.columns), strict=True) if batch is not None else []
            while len(held) >= block_entries or batch is None and held:
                some, held = held[:block_entries], held[block_entries:]
                if out is None:
                    name = f"{folder}/{uuid.uuid4().hex}.cdx.z"
                    fs, path = filesystem(name)
                    out = fs.open_output_stream(path + ".tmp")
                data = zlib.compress("\n".join(json.dumps(x) for x in some).encode(), 6)
                out.write(data)
                blocks.append((some[0][0], some[-1][0], name, at, len(data), len(some)))
                at += len(data)
        if out is not None:
            out.close()
            publish(fs, path + ".tmp", path)
            write_sorted(name + SPARSE, [(first, last, start, length) for first, last, _, start, length, _ in blocks])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=[x.split()[0] for x in DIRECTORY.split(", ")])

    dealt = entries.repartitionByRange(parallelism(entries.sparkSession), "surt", "page_id").sortWithinPartitions("surt", "page_id")
    directory = staged(dealt.mapInArrow(write, DIRECTORY), "warc-directory")
    # One row per index file: as many as there are range partitions.
    files = directory.groupBy("index_file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("first", "last").collect()
    write_sorted(f"{folder}/{TOP}", [(r["first"], r["last"], r.index_file) for r in files])
    return directory


def write_sorted(uri: str, rows: list[tuple]) -> None:
    """Rows (first key, last key, ...) in order, then the table of their offsets and their number, for bisection in place."""
    fs, path = filesystem(uri)
    data = [json.dumps(r).encode() for r in rows]
    offsets = [0, *itertools.accumulate(map(len, data))]
    with fs.open_output_stream(path + ".tmp") as out:
        out.write(b"".join(data) + struct.pack(f"<{len(offsets) + 1}Q", *offsets, len(rows)))
    publish(fs, path + ".tmp", path)


class SortedFile:
    """A file of ``write_sorted``; every access is a range read of one row."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file, self.size = fs.open_input_file(path), fs.get_file_info(path).size
        self.n = struct.unpack("<Q", self.file.read_at(8, self.size - 8))[0]
        self.table = self.size - 8 - 8 * (self.n + 1)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> list:
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, end = struct.unpack("<2Q", self.file.read_at(16, self.table + 8 * i))
        return json.loads(self.file.read_at(end - start, start))

    def holding(self, key: str) -> Iterator[list]:
        """The rows whose keys from first to last include ``key``."""
        i = bisect.bisect_left(self, key, key=lambda row: row[1])
        while i < self.n and (row := self[i])[0] <= key:
            yield row
            i += 1


def _block(name: str, start: int, length: int) -> list[list]:
    fs, path = filesystem(name)
    with fs.open_input_file(path) as f:
        data = zlib.decompress(f.read_at(length, start))
    return [json.loads(x) for x in data.decode().split("\n")]


def read_entries(directory: DataFrame) -> DataFrame:
    """All capture entries, through the directory's blocks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start, length in zip(*(batch.column(c).to_pylist() for c in ("index_file", "start", "length")), strict=True):
                rows = _block(name, start, length)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])

    return directory.repartition(parallelism(directory.sparkSession)).mapInArrow(read, ENTRY)


def _records(archive: str, ranges: list[tuple[int, int]], gap: int = 1 << 16, most: int = 8 << 20) -> Iterator[bytes]:
    """The records at ascending ranges of one archive; ranges that lie close together are read at once."""
    fs, path = filesystem(archive)
    with fs.open_input_file(path) as f:
        i = 0
        while i < len(ranges):
            j, end = i + 1, sum(ranges[i])
            while j < len(ranges) and ranges[j][0] - end <= gap and sum(ranges[j]) - ranges[i][0] <= most:
                end, j = max(end, sum(ranges[j])), j + 1
            data = memoryview(f.read_at(end - ranges[i][0], ranges[i][0]))
            for start, length in ranges[i:j]:
                at = start - ranges[i][0]
                yield zlib.decompress(data[at : at + length], 31)
            i = j


def read_archives(directory: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record by way of the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    types = {"url": pa.string(), "payload_digest": pa.string(), "record_type": pa.string(), "payload": pa.binary()}

    def flush(archive: str, ranges: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        rows = []
        for data in _records(archive, ranges):
            rows.append(parse(data))
            if not with_payload:
                rows[-1]["payload"] = None
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.int64())) for n in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ranges = None, []
        for batch in batches:
            for archive, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if archive != now or len(ranges) >= 2000:
                    yield from flush(now, ranges) if ranges else ()
                    now, ranges = archive, []
                ranges.append((start, length))
        yield from flush(now, ranges) if ranges else ()

    ranges = read_entries(directory).select("archive", "start", "length")
    dealt = ranges.repartition(parallelism(directory.sparkSession), "archive").sortWithinPartitions("archive", "start")
    kind = {"url": "string", "payload_digest": "string", "record_type": "string", "payload": "binary"}
    return dealt.mapInArrow(read, ", ".join(f"{n} {kind.get(n, 'long')}" for n in names))


def lookup(folder: str, url: str) -> Iterator[dict]:
    """All captures of ``url`` (by key), one after another, by the index below ``folder``."""
    key = surt(url)
    for _, _, name in SortedFile(f"{folder}/{TOP}").holding(key):
        for _, _, start, length in SortedFile(name + SPARSE).holding(key):
            entries = _block(name, start, length)
            for e in entries[bisect.bisect_left(entries, key, key=lambda e: e[0]) : bisect.bisect_right(entries, key, key=lambda e: e[0])]:
                yield from (parse(x) for x in _records(e[5], [(e[6], e[7])]))


def verify_revisits(records: DataFrame) -> None:
    """Every revisit's size and digest are those of a response with the id it refers to; each claim is looked up once."""
    claims = records.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    wrong = claims.join(records.filter("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes"), ["page_id", "payload_digest", "payload_bytes"], "left_anti").take(1)
    if wrong:
        raise ValueError(f"a revisit refers to page {wrong[0].page_id}, which has another payload")


def archive_and_read_back(pages: DataFrame) -> DataFrame:
    spark: SparkSession = pages.sparkSession
    folder = shared_folder(spark, "warc")
    directory = write_index(write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    found = staged(read_archives(directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    verify_revisits(found)
    return found
