"""Token ids in sorted-string-table shards: written in order of the identifier, read back, looked up.

A shard is a file of blocks, a sparse block index, a Bloom filter and a footer. Keys are byte strings
whose order is the identifiers' order; in a block a key repeats only what differs from the key before.

    block   zstd of entries: varint shared, varint rest, varint n, rest of the key, n ids
    index   for each block: u16 key length, first key, u64 offset, u32 stored bytes, u64 ids before it
    filter  bits of a Bloom filter over the keys (double hashing by XXH64)
    footer  u64 index at, u64 filter at, u64 documents, u64 ids, u32 blocks, u16 bytes of an id, u16 hashes, 8 bytes of magic
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import scratch, staged
from .tokens import encoder

FOOTER = struct.Struct("<QQQQIHH8s")
ENTRY = struct.Struct("<QIQ")
MAGIC = b"SWSSTBL1"


def key_of(value) -> bytes:
    """Order-preserving bytes of an identifier: null first, integers by value, strings by code point."""
    if value is None:
        return b"\x00"
    if isinstance(value, int):
        return b"\x01" + (value + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + str(value).encode()


def value_of(key: bytes):
    if key[0] == 0:
        return None
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] == 1 else key[1:].decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _places(key: bytes, bits: int, hashes: int) -> Iterator[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return ((a + i * b) % bits for i in range(hashes))


class Writer:
    """Writes one shard; keys must come in order, equal keys are separate entries."""

    def __init__(self, sink, *, width: int = 2, block_bytes: int = 1 << 16, hashes: int = 7, bits_a_key: int = 10):
        self.sink, self.width, self.block_bytes, self.hashes, self.bits_a_key = sink, width, block_bytes, hashes, bits_a_key
        self.type = "<u2" if width == 2 else "<u4"
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self.at = self.docs = self.ids = self.before = 0
        self.block, self.size, self.first, self.last = [], 0, None, b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.hashed: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.first is None:
            self.first, self.last, self.before = key, b"", self.ids
        elif key < self.last:
            raise ValueError("keys must come in ascending order")
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id does not fit into {self.width} bytes")
        body = ids.astype(self.type).tobytes()
        self.block += [_varint(shared), _varint(len(key) - shared), _varint(len(ids)), key[shared:], body]
        self.size += len(body) + len(key) + 6
        self.last = key
        self.hashed.append(key)
        self.docs += 1
        self.ids += len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.first is None:
            return
        stored = self.squeeze.compress(b"".join(self.block))
        self.sink.write(stored)
        self.index.append((self.first, self.at, len(stored), self.before))
        self.at += len(stored)
        self.block, self.size, self.first = [], 0, None

    def close(self) -> None:
        self._flush()
        index_at = self.at
        index = b"".join(struct.pack("<H", len(k)) + k + ENTRY.pack(at, n, before) for k, at, n, before in self.index)
        bits = max(64, self.bits_a_key * len(self.hashed) + 7 & ~7)
        marks = np.zeros(bits // 8, dtype=np.uint8)
        for key in self.hashed:
            for p in _places(key, bits, self.hashes):
                marks[p >> 3] |= 1 << (p & 7)
        self.sink.write(index)
        self.sink.write(marks.tobytes())
        self.sink.write(FOOTER.pack(index_at, index_at + len(index), self.docs, self.ids, len(self.index), self.width, self.hashes, MAGIC))


class Reader:
    """Reads one shard from a seekable file: scan() in order, get(key) by filter and binary search."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - FOOTER.size)
        self.index_at, filter_at, self.docs, self.ids, blocks, width, self.hashes, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self.type, self.width = ("<u2" if width == 2 else "<u4"), width
        source.seek(self.index_at)
        data = source.read(end - FOOTER.size - self.index_at)
        self.marks = data[filter_at - self.index_at :]
        self.keys, self.blocks, at = [], [], 0
        for _ in range(blocks):
            (n,) = struct.unpack_from("<H", data, at)
            self.keys.append(data[at + 2 : at + 2 + n])
            self.blocks.append(ENTRY.unpack_from(data, at + 2 + n))
            at += 2 + n + ENTRY.size

    def _entries(self, block: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        at, n, before = self.blocks[block]
        self.source.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.source.read(n))
        at, key = 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, before, np.frombuffer(data, self.type, n, at)
            at += n * self.width
            before += n

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """key, ids before it in the shard, ids."""
        for block in range(len(self.blocks)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of every entry of key; none if there is none."""
        bits = 8 * len(self.marks)
        if not all(self.marks[p >> 3] >> (p & 7) & 1 for p in _places(key, bits, self.hashes)):
            return []
        found = []
        for block in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.blocks)):
            if self.keys[block] > key:
                break
            found += [ids for k, _, ids in self._entries(block) if k == key]
        return found


def _open(path: str):
    where, name = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return where, name


def _written(folder: str, path: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        codes = encoder(path, spaces=True, limit=350_000)
        end = np.array([end_id], dtype="<u4")
        # Each attempt writes its own file; only the files of attempts that succeeded are named in the result.
        where, name = _open(f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.sst")
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                where.create_dir(name.rpartition("/")[0], recursive=True)
                sink = where.open_output_stream(name)
                writer = Writer(sink, width=width)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                writer.add(key_of(doc_id), np.concatenate([np.frombuffer(codes.encode(text.as_py() or ""), "<u4"), end]))
        if writer is not None:
            writer.close()
            sink.close()
            row = {"part": context.partitionId(), "path": f"{folder}/{name.rpartition('/')[2]}", "docs": writer.docs, "ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def write(docs: DataFrame, tokenizer: str, *, folder: str | None = None, end_id: int = 2, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs as shards in ascending order of the identifier; one row per shard: part, path, docs, ids, before.

    before is the number of ids in all shards before it. Null texts count as empty and hold the end id
    alone; null identifiers come first; rows that repeat an identifier are entries of their own. An
    empty table writes no shard. width is the bytes of an id (2 for vocabularies up to 65,536).
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sst")
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # The text's hash parts rows that repeat one identifier.
    ranged = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = staged(ranged.mapInArrow(_written(folder, tokenizer, end_id, width), "part int, path string, docs long, ids long"), "sst-shards")
    return shards.withColumn("before", F.sum("ids").over(Window.orderBy("part")) - F.col("ids"))


def _read(id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    rows = []
                    for key, start, ids in Reader(source).scan():
                        rows.append((value_of(key), before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def read(shards: DataFrame, id_type) -> DataFrame:
    """Read shards back, a task each: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    n = max(1, shards.count())  # one row for each shard
    spread = shards.select("path", "before", "part").repartitionByRange(n, "part").select("path", "before")
    return spread.mapInArrow(_read(to_arrow_type(id_type)), f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, shards: DataFrame, doc_id) -> list[np.ndarray]:
    """The ids of every document named doc_id: one probe of each shard's filter and index, spread over tasks."""
    key = key_of(doc_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = _open(path)
                with where.open_input_file(name) as source:
                    found = [ids.astype("<u4").tobytes() for ids in Reader(source).get(key)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(found, type=pa.binary())], names=["ids"])

    return [np.frombuffer(r["ids"], "<u4") for r in shards.select("path").mapInArrow(run, "ids binary").collect()]
