"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A shard ``part-*.rec`` is a sequence of records, each
``length u64 | masked crc of length u32 | payload | masked crc of payload u32``,
all little-endian. The payload is ``flags u8 | width u8 | doc_id i64 | n u32 |
n ids of width bytes``. Its index ``part-*.idx`` holds the u64 byte offset of
every record, so a reader can fetch records in any order. The checksum is CRC-32
(zlib), masked as ``rotate right by 15, add 0xa282ead8`` so that stored
checksums can themselves be checksummed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civilake.llm.staging import fresh_path, qualified, staged
from civilake.llm.tokens import END_ID, encoder, small_runs

HEAD = struct.Struct("<QI")
TAIL = struct.Struct("<I")
META = struct.Struct("<BBqI")
MASK_DELTA = 0xA282EAD8
SHARD_BYTES = 64 << 20

MANIFEST = "shard int, part int, path string, index_path string, records long, ids long, bytes long"


def masked(data: bytes) -> int:
    """The masked CRC-32 of some bytes."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    """One record."""
    payload = META.pack(doc_id is None, width, doc_id or 0, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(data: memoryview, at: int) -> tuple[int | None, np.ndarray, int]:
    """The record at a byte offset: doc_id, ids, and the offset after it. Raises ValueError if a checksum is wrong."""
    length, crc = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != crc:
        raise ValueError(f"corrupt length at byte {at}")
    body = data[at + HEAD.size : at + HEAD.size + length]
    (crc,) = TAIL.unpack_from(data, at + HEAD.size + length)
    if len(body) != length or masked(bytes(body)) != crc:
        raise ValueError(f"corrupt payload at byte {at}")
    missing, width, doc_id, n = META.unpack_from(body)
    ids = np.frombuffer(body[META.size :], dtype=f"<u{width}")
    if len(ids) != n:
        raise ValueError(f"wrong id count at byte {at}")
    return None if missing else doc_id, ids, at + HEAD.size + length + TAIL.size


def open_fs(url: str):
    """The file system and path of a qualified URL; one without a scheme is an error, since it could mean another place in each process.

    Schemes are those of Arrow's file systems: ``file``, ``hdfs`` and ``viewfs``
    (through libhdfs), ``s3``, ``gs``, ``abfs``; ``s3a`` and ``abfss`` are taken as
    ``s3`` and ``abfs``. Credentials come from the executors' environment.
    """
    from pyarrow import fs

    for hadoop, arrow in (("s3a://", "s3://"), ("abfss://", "abfs://")):
        url = arrow + url.removeprefix(hadoop) if url.startswith(hadoop) else url
    if ":/" not in url:
        raise ValueError(f"{url} has no scheme")
    return fs.FileSystem.from_uri(url)


class ShardWriter:
    """Writes records under temporary names and renames whole files, so a retried task never leaves half a shard."""

    def __init__(self, folder: str, shard: int):
        self.shard, self.url = shard, folder
        self.fs, self.folder = open_fs(folder)
        self.part = 0
        self.done: list[tuple] = []
        self.stream = None

    def _open(self) -> None:
        self.fs.create_dir(self.folder, recursive=True)
        self.name = f"part-{self.shard:06d}-{self.part:04d}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(f"{self.folder}/{self.name}.tmp")
        self.offsets: list[int] = []
        self.bytes = self.ids = 0

    def write(self, doc_id: int | None, ids: bytes, width: int) -> None:
        if self.stream is None:
            self._open()
        record = frame(doc_id, ids, width)
        self.offsets.append(self.bytes)
        self.stream.write(record)
        self.bytes += len(record)
        self.ids += len(ids) // width
        if self.bytes >= SHARD_BYTES:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        self.stream = None
        with self.fs.open_output_stream(f"{self.folder}/{self.name}.idx.tmp") as out:
            out.write(np.array(self.offsets, "<u8").tobytes())
        for ending in (".rec", ".idx"):
            self.fs.move(f"{self.folder}/{self.name}{'.tmp' if ending == '.rec' else '.idx.tmp'}", f"{self.folder}/{self.name}{ending}")
        path = f"{self.url}/{self.name}"
        self.done.append((self.shard, self.part, f"{path}.rec", f"{path}.idx", len(self.offsets), self.ids, self.bytes))
        self.part += 1


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_MANIFEST = pa.schema(
    [("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("index_path", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]
)
_READ = pa.schema([("doc_id", pa.int64()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """Encode whole texts, append ``end_id`` and write shards in ascending id order; returns the manifest, one row per shard file.

    Null text counts as empty; null ids come first. Ids must fit in 64 bits.
    Documents are range-partitioned by id before they are encoded, so each task
    writes its own consecutive range. The manifest lists only files of
    successful tasks; files of lost attempts are not in it. An empty table gives
    an empty manifest. ``folder`` is qualified on the driver; on a file system that
    Arrow cannot write the tasks fail. Rows of one id, and those without one, stand in no
    particular order among themselves, and all lie in one task's range.
    """
    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(tokenizer_path)
        end = (end_id or 0).to_bytes(tokens.width, "little") if end_id is not None else b""
        writer = ShardWriter(folder, TaskContext.get().partitionId())
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = pa.compute.binary_length(texts).fill_null(0).to_pylist()
            for start, stop in small_runs(lengths):
                for doc_id, found in zip(ids[start:stop], tokens.encode(texts[start:stop].to_pylist()), strict=True):
                    writer.write(doc_id, found + end, tokens.width)
        writer.close()
        tokens.rest()
        yield _rows(writer.done, _MANIFEST)

    import pyarrow.compute  # noqa: F401

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"))
    return staged(ordered.mapInArrow(write, MANIFEST), "records-manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read every record back: ``doc_id, start, n_tokens, ids_crc32``, start being the ids of all records before it.

    Starts come from the manifest's running total, one row per shard file (of 64
    MB, so the one task that adds them up has 1.6 million short rows at 100 TB),
    and a running count inside each file. A wrong checksum fails the job.
    """
    order = Window.orderBy("shard", "part")
    shards = manifest.withColumn("first", F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as source:
                    data = memoryview(source.read_buffer())
                at, rows = 0, []
                while at < len(data):
                    doc_id, ids, at = unframe(data, at)
                    rows.append((doc_id, first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    first += len(ids)
                yield _rows(rows, _READ)

    files = shards.select("path", "first")
    n = max(1, manifest.count())
    spread = files.repartition(n, "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_at(index_path: str, numbers: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard by their numbers, in any order, through the offset index."""
    fs, name = open_fs(index_path)
    with fs.open_input_file(name) as source:
        offsets = np.frombuffer(source.read_buffer(), "<u8")
    with fs.open_input_file(name[: -len("idx")] + "rec") as source:
        out = []
        for number in numbers:
            source.seek(int(offsets[number]))
            head = source.read(HEAD.size)
            rest = source.read(HEAD.unpack(head)[0] + TAIL.size)
            out.append(unframe(memoryview(head + rest), 0)[:2])
    return out


def op8(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The rows of query ``op8_token_records``: written, then read back."""
    return read_records(write_records(docs, tokenizer_path, fresh_path(docs.sparkSession, "records")))
