"""BAM files as tables, and tables as BAM files.

A BGZF file is a run of gzip members, so a reader streams it through ``zlib`` one member at a time, from any member on. Files
are read in splits: a task reads the records that start in its members, from the first record there to the first one of the
next split, and fails unless it comes out exactly there. Written parts are whole BAM files of their own, one per partition, sorted by ordinal, each
closed by the BGZF end marker and given its name only when whole.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08\x04"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
OPS = "MIDNSHP=X"
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
CODES = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: Tags that this engine writes; they are dropped before it writes them again.
OWN_TAGS = ("MI", "uN", "uS", "uJ", "uD", "uA", "uP", "uF", "uT", "uG")
RECORDS = "ordinal long, qname string, flag int, tid int, pos int, mapq int, cigar array<struct<op:string,len:int>>, rx string, ts_dorado string, ts_mm2 string, qs float, pt int, has_sa boolean, had_stale boolean, raw binary"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def members(stream, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(place of the member in the file, place in the member, bytes) of a BGZF stream that stands at place ``at``."""
    unzip, inner, fed = zlib.decompressobj(31), 0, 0
    while data := stream.read(1 << 20):
        while data:
            out = unzip.decompress(data)
            fed += len(data) - len(unzip.unused_data)
            if out:
                yield at, inner, out
                inner += len(out)
            data = unzip.unused_data
            if unzip.eof:
                at, inner, fed, unzip = at + fed, 0, 0, zlib.decompressobj(31)
    if fed:
        raise ValueError("the file is cut short within a block")


class _Bytes:
    """Exact reads from members, with the place of the next byte."""

    def __init__(self, parts: Iterator[tuple[int, int, bytes]]):
        self.parts, self.held, self.at, self.done, self.marks = parts, b"", 0, 0, deque()

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        rest = self.held[self.at :]
        self.marks.append((self.done + len(rest), part[0], part[1]))
        self.held, self.at = rest + part[2], 0
        return True

    def read(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self.more():
            pass
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        self.done += len(out)
        return out

    def peek(self, start: int, n: int) -> bytes:
        """``n`` bytes from ``start`` bytes ahead on, or fewer at the end."""
        while len(self.held) - self.at < start + n and self.more():
            pass
        return self.held[self.at + start : self.at + start + n]

    def place(self, ahead: int = 0) -> tuple[int, int] | None:
        """(member, place in it) of the byte ``ahead`` bytes ahead; None: there is none."""
        if not self.peek(ahead, 1):
            return None
        while len(self.marks) > 1 and self.marks[1][0] <= self.done:
            self.marks.popleft()
        first, member, inner = next(m for m in reversed(self.marks) if m[0] <= self.done + ahead)
        return member, inner + self.done + ahead - first


def read_head(source: _Bytes) -> tuple[str, list[tuple[str, int]]]:
    """Header text and contigs (name, length)."""
    if source.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = source.read(struct.unpack("<i", source.read(4))[0]).rstrip(b"\0").decode()
    contigs = []
    for _ in range(struct.unpack("<i", source.read(4))[0]):
        name = source.read(struct.unpack("<i", source.read(4))[0])[:-1].decode()
        contigs.append((name, struct.unpack("<i", source.read(4))[0]))
    return text, contigs


def header(path: str) -> tuple[str, list[tuple[str, int]]]:
    fs, p = _open(path)
    with fs.open_input_stream(p, compression=None) as f:
        return read_head(_Bytes(members(f)))


def first_member(f, at: int, size: int) -> int:
    """Place of the first whole BGZF block at or after ``at``; ``size``: none."""
    while at < size:
        data = f.read_at(min(1 << 17, size - at), at)
        found = data.find(MAGIC)
        while found >= 0:
            block = f.read_at(min(1 << 16, size - at - found), at + found)
            unzip = zlib.decompressobj(31)
            try:
                unzip.decompress(block)
            except zlib.error:
                pass
            else:
                if unzip.eof and block[12:16] == b"BC\x02\x00" and len(block) - len(unzip.unused_data) == struct.unpack_from("<H", block, 16)[0] + 1:
                    return at + found
            found = data.find(MAGIC, found + 1)
        at += max(1, len(data) - len(MAGIC) + 1)
    return size


def _is_record(source: _Bytes, at: int, n_contigs: int) -> int:
    """Length of what may be a record ``at`` bytes ahead, with its length field; 0: it is none."""
    fixed = source.peek(at, 36)
    if len(fixed) < 36:
        return 0
    size, tid, pos, l_name, _, _, n_cigar, _, l_seq, tid2, pos2, _ = struct.unpack("<iiiBBHHHiiii", fixed)
    if not (-1 <= tid < n_contigs and -1 <= tid2 < n_contigs and pos >= -1 and pos2 >= -1 and l_name and l_seq >= 0 and size >= 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq):
        return 0
    name = source.peek(at + 36, l_name)
    return size + 4 if len(name) == l_name and name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1]) else 0


def first_record(f, at: int, size: int, n_contigs: int) -> tuple[int, int]:
    """Place of the first record that starts in a block at or after ``at``; (size, 0): none.

    A record is taken for one if it and the 15 after it, or all up to the end of the file, have sound fields.
    """
    start = first_member(f, at, size)
    if start == size:
        return size, 0
    f.seek(start)
    source, ahead = _Bytes(members(f, start)), 0
    while source.peek(ahead, 36):
        end, good = ahead, 0
        while good < 16 and (length := _is_record(source, end, n_contigs)):
            end, good = end + length, good + 1
        if good == 16 or good and not source.peek(end, 1) and source.peek(end - 1, 1):
            return source.place(ahead)
        ahead += 1
    return size, 0


def require_sorted(text: str) -> None:
    """The header must promise coordinate order."""
    first = next((x for x in text.split("\n") if x.startswith("@HD")), "")
    if "SO:coordinate" not in first.split("\t"):
        raise ValueError("input is not coordinate-sorted: sort it by coordinate first")


def tags(data: bytes) -> list[tuple[str, str, object, int, int]]:
    """(name, type, value, start, end) of the optional fields; stops at the first malformed one."""
    out, at = [], 0
    while at + 3 <= len(data):
        name, kind, start = data[at : at + 2].decode("ascii", "replace"), chr(data[at + 2]), at
        at += 3
        if kind in "ZH":
            end = data.find(b"\0", at)
            if end < 0:
                break
            value, at = data[at:end].decode("ascii", "replace"), end + 1
        elif kind == "B":
            if at + 5 > len(data) or (width := SIZES.get(chr(data[at]))) is None:
                break
            n = struct.unpack_from("<I", data, at + 1)[0]
            value, at = None, at + 5 + n * width
        elif kind in SIZES:
            if at + SIZES[kind] > len(data):
                break
            value = chr(data[at]) if kind == "A" else struct.unpack_from(CODES[kind], data, at)[0]
            at += SIZES[kind]
        else:
            break
        if at > len(data):
            break
        out.append((name, kind, value, start, at))
    return out


def parse(ordinal: int, raw: bytes) -> tuple:
    """A record's columns. A later tag of the same name wins; tags of an unexpected type do not count."""
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32 + l_name
    cigar = [{"op": OPS[v & 15], "len": v >> 4} for v in struct.unpack_from(f"<{n_cigar}I", raw, at)]
    at += 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    found = {}
    for name, kind, value, _, _ in tags(raw[at:]):
        if name == "RX" and kind == "Z" or name in ("TS", "ts") and kind == "A" or name == "qs" and kind in CODES or name == "pt" and kind in CODES and kind != "f" or name == "SA" or name in OWN_TAGS:
            found[name] = value
    pt = found.get("pt")
    return (
        ordinal, raw[32 : 31 + l_name].decode("ascii", "replace"), flag, tid, pos, mapq, cigar, found.get("RX"), found.get("TS"), found.get("ts"),
        None if found.get("qs") is None else float(found["qs"]), None if pt is None else max(-1, min(int(pt), 2**31 - 1)), "SA" in found, any(t in found for t in OWN_TAGS), raw,
    )


def records_of(path: str, start: int, end: int, size: int, n_contigs: int) -> Iterator[bytes]:
    """The records that start in the blocks of a file from ``start`` up to ``end``."""
    fs, p = _open(path)
    with fs.open_input_file(p) as f:
        last = first_record(f, end, size, n_contigs) if end < size else (size, 0)
        first = first_record(f, start, size, n_contigs) if start else (0, 0)
        if first >= last:
            return
        f.seek(first[0])
        source = _Bytes(members(f, first[0]))
        if start:
            source.read(first[1])
        else:
            read_head(source)
        while (at := source.place() or (size, 0)) < last:
            length = source.read(4)
            raw = source.read(struct.unpack("<i", length)[0]) if len(length) == 4 else b""
            if len(raw) < 32 or len(raw) < struct.unpack("<i", length)[0]:
                raise ValueError(f"{path} is cut short within a record")
            yield raw
        if at != last:
            raise ValueError(f"the records of {path} do not meet at {last}: read it with split_bytes=0")


def read_bam(spark: SparkSession, paths: list[str], sorted_only: bool = True, split_bytes: int = 128 << 20) -> DataFrame:
    """Records of BAM files; ordinals grow within a file and from file to file.

    Files are read in splits of ``split_bytes`` (0: whole), one task each; an ordinal is the number of the split times
    2**32 and the record's number in it.
    """
    files, splits = [], 0
    for p in paths:
        text, contigs = header(p)
        if sorted_only:
            require_sorted(text)
        fs, inner = _open(p)
        size = fs.get_file_info(inner).size
        n = -(-size // split_bytes) if split_bytes else 1
        files.append((splits, n, p, size, len(contigs)))
        splits += n
    kinds = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.list_(pa.struct([("op", pa.string()), ("len", pa.int32())])), *[pa.string()] * 3, pa.float32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
    names = [re.match(r"\w+", x)[0] for x in re.split(r", (?=\w+ )", RECORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                end = split["start"] + split_bytes if split_bytes else split["size"]
                rows = []
                for n, raw in enumerate(records_of(split["path"], split["start"], min(end, split["size"]), split["size"], split["contigs"])):
                    rows.append(parse((split["number"] << 32) + n, raw))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    table = spark.createDataFrame(files, "first long, n long, path string, size long, contigs int").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    table = table.select((F.col("first") + F.col("k")).alias("number"), "path", (F.col("k") * split_bytes).alias("start"), "size", "contigs")
    # Out of one partition, so that the rows are dealt one to a task.
    return table.coalesce(1).repartition(max(1, splits)).mapInArrow(run, RECORDS)


def _block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def head_bytes(text: str, contigs: list[tuple[str, int]]) -> bytes:
    out = b"BAM\x01" + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(contigs))
    return out + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in contigs)


def with_program(text: str, name: str, version: str, command: str) -> str:
    """The header with one more @PG line, chained to the last; the id is the name or the first free ``name.k``."""
    ids = [next((f[3:] for f in x.split("\t") if f.startswith("ID:")), "") for x in text.split("\n") if x.startswith("@PG")]
    own = next(i for i in (name, *(f"{name}.{k}" for k in range(1, len(ids) + 2))) if i not in ids)
    line = f"@PG\tID:{own}\tPN:{name}" + (f"\tPP:{ids[-1]}" if ids else "") + f"\tVN:{version}\tCL:" + re.sub(r"[\t\r\n]", " ", command)
    return text.rstrip("\n") + "\n" + line + "\n"


def retagged(raw: bytes, flag: int, new: list[tuple[str, str, object]]) -> bytes:
    """A record with another flag and with its own tags of earlier runs replaced by ``new`` (name, type Z, i or A, value)."""
    l_name, n_cigar, l_seq = raw[8], struct.unpack_from("<H", raw, 12)[0], struct.unpack_from("<i", raw, 16)[0]
    at = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
    found = tags(raw[at:])
    kept = b"".join(raw[at + s : at + e] for n, _, _, s, e in found if n not in OWN_TAGS) + raw[at + (found[-1][4] if found else 0) :]
    more = b"".join(n.encode() + t.encode() + (str(v).encode() + b"\0" if t == "Z" else struct.pack("<i", v) if t == "i" else str(v).encode()) for n, t, v in new)
    return raw[:14] + struct.pack("<H", flag) + raw[16:at] + kept + more


def write_bam(records: DataFrame, folder: str, text: str, contigs: list[tuple[str, int]], whole: bool = True) -> DataFrame:
    """Write (ordinal, flag, raw, tags) below ``folder``, a file per range of ordinals; returns (part, file, n).

    ``tags`` (array of name, type, value; null: none) replace this engine's tags of earlier runs. Parts are BAM files of
    their own, or, if not ``whole``, bodies that ``merge`` joins. The action on the result writes; files of failed attempts
    are not listed.
    """
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    head, tail = (head_bytes(text, contigs), EOF) if whole else (b"", b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, held, name, fs, written = None, bytearray(), "", None, 0
        for batch in batches:
            for flag, raw, tags in zip(*(batch.column(c).to_pylist() for c in ("flag", "raw", "tags")), strict=True):
                if out is None:
                    fs, base = _open(folder)
                    name = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
                    out, held = fs.open_output_stream(name + ".tmp", compression=None), bytearray(head)
                record = retagged(raw, flag, [(t["name"], t["type"], int(t["value"]) if t["type"] == "i" else t["value"]) for t in tags or ()])
                held += struct.pack("<i", len(record)) + record
                written += 1
                while len(held) >= 0xFF00:
                    out.write(_block(bytes(held[:0xFF00])))
                    del held[:0xFF00]
        if out is not None:
            out.write((_block(bytes(held)) if held else b"") + tail)
            out.close()
            fs.move(name + ".tmp", name)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([written], pa.int64())], names=["part", "file", "n"])

    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shaped = records.select("ordinal", "flag", "raw", "tags")
    return shaped.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal").mapInArrow(run, "part int, file string, n long")


def require_end(path: str) -> None:
    """The file must end with the BGZF end marker."""
    fs, p = _open(path)
    size = fs.get_file_info(p).size
    with fs.open_input_file(p) as f:
        if size < len(EOF) or f.read_at(len(EOF), size - len(EOF)) != EOF:
            raise ValueError(f"{path} is cut short: the end marker is missing")


def merge(files: list[str], path: str, text: str, contigs: list[tuple[str, int]]) -> None:
    """One BAM file of bodies in order: header, bodies as they are, end marker; it gets its name when whole."""
    fs, p = _open(path)
    with fs.open_output_stream(p + ".tmp", compression=None) as out:
        head = head_bytes(text, contigs)
        out.write(b"".join(_block(head[i : i + 0xFF00]) for i in range(0, len(head), 0xFF00)))
        for name in files:
            with fs.open_input_stream(name, compression=None) as f:
                while data := f.read(8 << 20):
                    out.write(data)
        out.write(EOF)
    require_end(path + ".tmp")
    fs.move(p + ".tmp", p)
