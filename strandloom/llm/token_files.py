"""Token-id files: Arrow IPC files of fixed-size-list batches, for zero-copy random access to equal-length sequences.

``write_token_files`` range-partitions documents by ``doc_id`` (and by size where ids are equal), encodes them in the
writing task and writes one shard per partition. A shard's stream of ids is cut into rows of ``sequence_length`` ids;
a document may run over row ends; the shard's last row is padded with 0 and its mask is false there. Every shard has
two Arrow files: ``*.tokens.arrow`` (``input_ids`` fixed_size_list<uint16 or uint32>, ``mask`` fixed_size_list<bool>)
and ``*.docs.arrow`` (doc_id, start in the shard, n_tokens). Files get their final name only when whole; the returned
index names the files of the successful attempt, so a repeated attempt leaves unnamed files but never wrong rows.

Defined results: null and empty texts have the end id alone; an empty table has an empty index; a null ``doc_id``
sorts first; rows with the same ``doc_id`` are all kept, one after another by the length of their texts; other columns
are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_folder, filesystem, parallelism, publish, shared_folder, staged
from .tokens import default_vocabulary, encoder

SEQUENCE_LENGTH = 2048
ROWS_PER_BATCH = 512
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def token_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Streams ids into equal-length rows; holds one batch at a time."""

    def __init__(self, folder: str, shard: int, dtype: np.dtype, length: int):
        self.fs, self.folder = filesystem(folder)
        self.stem = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
        self.base = f"{self.folder}/{self.stem.rpartition('/')[2]}"
        self.dtype, self.length = dtype, length
        self.schema = token_schema(dtype, length)
        self.files = [self.fs.open_output_stream(f"{self.base}.{k}.tmp") for k in ("tokens", "docs")]
        self.tokens = pa.ipc.new_file(self.files[0], self.schema)
        self.docs = pa.ipc.new_file(self.files[1], DOCS)
        self.parts: list[bytes] = []
        self.held = self.written = 0
        self.limit = length * ROWS_PER_BATCH * dtype.itemsize

    def add(self, ids: list[bytes]) -> None:
        self.parts += ids
        self.held += sum(map(len, ids))
        if self.held >= self.limit:
            data = b"".join(self.parts)
            row = self.length * self.dtype.itemsize
            whole = len(data) // row * row
            for at in range(0, whole, self.limit):
                self._batch(np.frombuffer(data[at : min(at + self.limit, whole)], self.dtype), None)
            self.parts, self.held = [data[whole:]], len(data) - whole

    def _batch(self, ids: np.ndarray, real: int | None) -> None:
        mask = np.ones(len(ids), bool)
        if real is not None:
            mask[real:] = False
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.tokens.write_batch(pa.record_batch(cols, schema=self.schema))

    def close(self) -> str:
        rest = np.frombuffer(b"".join(self.parts), self.dtype)
        if len(rest):
            padded = np.zeros(-(-len(rest) // self.length) * self.length, self.dtype)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        for writer, f, kind in zip((self.tokens, self.docs), self.files, ("tokens", "docs"), strict=True):
            writer.close()
            f.close()
            publish(self.fs, f"{self.base}.{kind}.tmp", f"{self.base}.{kind}.arrow")
        return self.stem


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, sequence_length: int = SEQUENCE_LENGTH, shards: int | None = None) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``folder``; return the index: a row per shard (shard, stem, n_docs, n_tokens)."""
    ensure_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, n_docs, total, shard = encoder(vocabulary), None, 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or ShardWriter(folder, shard, enc.dtype, sequence_length)
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                ids = [enc.document(t.as_py()) for t in some.column(1)]
                sizes = np.array([len(x) // enc.dtype.itemsize for x in ids], np.int64)
                out.add(ids)
                starts = total + np.cumsum(sizes) - sizes
                out.docs.write_batch(pa.record_batch([some.column(0).cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=DOCS))
                n_docs, total = n_docs + len(ids), total + int(sizes.sum())
        enc.forget()
        if out:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "stem": [out.close()], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([total], pa.int64())})

    # Rows that share an id, or have none, need not share a task: ranges go by the bytes of a text too, known without reading it.
    order = (F.col("doc_id"), F.octet_length("text"))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(shards or parallelism(docs.sparkSession), *order).sortWithinPartitions(*order, F.xxhash64("text"))
    return staged(dealt.mapInArrow(write, "shard int, stem string, n_docs long, n_tokens long"), "token-index")


class TokenShard:
    """Random access to a shard: rows by number, or any range of its id stream, as views on the mapped file."""

    def __init__(self, stem: str):
        self.fs, base = filesystem(stem)
        self.source = pa.memory_map(f"{base}.tokens.arrow") if self.fs.type_name == "local" else self.fs.open_input_file(f"{base}.tokens.arrow")
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("input_ids").type.list_size
        with self.fs.open_input_file(f"{base}.docs.arrow") as f:
            self.docs = pa.ipc.open_file(f).read_all()
        self.held: tuple[int, np.ndarray] | None = None
        counts = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def ids(self, batch: int) -> np.ndarray:
        """All ids of a batch, one row after another, without a copy."""
        if self.held is None or self.held[0] != batch:
            column = self.reader.get_batch(batch).column("input_ids")
            self.held = batch, column.flatten().to_numpy(zero_copy_only=True)
        return self.held[1]

    def sequence(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        b = int(np.searchsorted(self.first, row, "right")) - 1
        at = (row - int(self.first[b])) * self.length
        mask = self.reader.get_batch(b).column("mask").slice(row - int(self.first[b]), 1).flatten()
        return self.ids(b)[at : at + self.length], mask.to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the stream from ``start``; a view where they lie in one batch."""
        parts, b = [], int(np.searchsorted(self.first * self.length, start, "right")) - 1
        while n > 0:
            at = start - int(self.first[b]) * self.length
            part = self.ids(b)[at : at + n]
            parts.append(part)
            start, n, b = start + len(part), n - len(part), b + 1
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])

    def close(self) -> None:
        self.held = None
        self.source.close()


def read_token_files(index: DataFrame) -> DataFrame:
    """Per document of the index's shards: doc_id, start (in all shards), n_tokens, ids_crc32 of its ids as uint32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = TokenShard(stem)
                for some in shard.docs.to_batches():
                    starts, sizes = some.column(1).to_numpy(), some.column(2).to_numpy()
                    crcs = [zlib.crc32(shard.span(int(s), int(n)).astype("<u4").tobytes()) for s, n in zip(starts, sizes, strict=True)]
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(starts + base), some.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    # One row per shard: the running sum orders as many rows as there are shards.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = index.select("stem", F.coalesce(before, F.lit(0)).cast("long").alias("base"))
    return shards.repartition(parallelism(index.sparkSession)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, vocabulary: str | None = None, sequence_length: int = SEQUENCE_LENGTH) -> DataFrame:
    folder = shared_folder(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, vocabulary or default_vocabulary(), sequence_length))
