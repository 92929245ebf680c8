"""Sorted-string-table shards of token ids, keyed by document identifier.

A shard is one file:

    block*  index  bloom  footer

* A block holds entries in key order, as zstd of `varint shared, varint unshared, varint value
  length, unshared key bytes, value`; `shared` counts the leading bytes that the key has in common
  with the key before it (0 at the start of a block). A crc32 of the stored bytes follows.
* The sparse index has one row per block: first key, offset, stored length, entries, ids before it.
* The Bloom filter has 10 bits per key and 7 probes by double hashing of one 128-bit hash.
* The footer has fixed length and ends in the magic, so a reader starts from the end of the file.

Keys order as signed 64-bit identifiers do (null first); a value is the document's ids, 2 or 4
bytes each. Shards are ranges of the identifier order, so a global binary search is: shard by its
first key, block by the sparse index, entry inside the block.
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
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import atomic_output, new_folder, open_read, table, written
from tessella.llm.tokens import encoder, le32

MAGIC = b"TSSTBL01"
FOOTER = struct.Struct("<QQQQQQIIII8s")  # index, bloom: offset, length; keys, ids; blocks, probes, width, crc; magic
ROW = struct.Struct("<HQIIQ")  # key length, offset, stored length, entries, ids before
BITS_PER_KEY, PROBES = 10, 7
#: A shard is closed at about this size, and the next one of its task is begun.
SHARD_BYTES = 256 << 20
#: Pieces that a worker's encoder knows at most (some 0.7 MB for a thousand): all workers of an executor fill their own.
CACHE_ENTRIES = 300_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = n = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _shared(a: bytes, b: bytes) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _bloom_hashes(keys: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_128_intdigest(k) & (1 << 64) - 1 for k in keys], np.uint64), np.array(
        [xxhash.xxh3_128_intdigest(k) >> 64 | 1 for k in keys], np.uint64
    )


def _bloom_bits(keys: list[bytes], bits: int) -> np.ndarray:
    a, b = _bloom_hashes(keys)
    with np.errstate(over="ignore"):
        return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(PROBES)])


class Writer:
    """Writes one shard to an open file; keys must come in ascending order."""

    def __init__(self, file, width: int, block_bytes: int = 64 << 10):
        self.file, self.width, self.block_bytes = file, width, block_bytes
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.at = self.ids = self.block_ids = self.entries = 0
        self.block, self.size, self.first, self.last = [], 0, b"", b""
        self.index, self.keys = [], []

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        n = _shared(self.last, key) if self.entries else 0
        if not self.entries:
            self.first, self.block_ids = key, self.ids
        self.block += [_varint(n), _varint(len(key) - n), _varint(len(value)), key[n:], value]
        self.size += len(value) + len(key) - n + 8
        self.entries, self.last = self.entries + 1, key
        self.ids += len(value) // self.width
        self.keys.append(key)
        if self.size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        data = self.zstd.compress(b"".join(self.block))
        data += struct.pack("<I", zlib.crc32(data))
        self.file.write(data)
        self.index.append(ROW.pack(len(self.first), self.at, len(data), self.entries, self.block_ids) + self.first)
        self.at += len(data)
        self.block, self.size, self.entries, self.last = [], 0, 0, b""

    def finish(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, BITS_PER_KEY * len(self.keys) + 63 & ~63)
        bitmap = np.zeros(bits, np.uint8)
        for at in range(0, len(self.keys), 100_000):
            bitmap[_bloom_bits(self.keys[at : at + 100_000], bits).ravel().astype(np.int64)] = 1
        bloom = np.packbits(bitmap).tobytes()
        self.file.write(index + bloom)
        self.file.write(
            FOOTER.pack(
                self.at, len(index), self.at + len(index), len(bloom), len(self.keys), self.ids,
                len(self.index), PROBES, self.width, zlib.crc32(index + bloom), MAGIC,
            )
        )


class Reader:
    """Reads a shard: footer, index and Bloom filter at once, blocks when asked for."""

    def __init__(self, uri: str):
        self.file = open_read(uri)
        self.file.seek(0, 2)
        end = self.file.tell()
        foot = self._range(end - FOOTER.size, FOOTER.size)
        at, size, bloom_at, bloom_size, self.n_keys, self.n_ids, blocks, _, self.width, crc, magic = FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        data = self._range(at, size + bloom_size)
        if zlib.crc32(data) != crc:
            raise ValueError(f"damaged shard: {uri}")
        self.bloom = np.frombuffer(data[size:], np.uint8)
        self.rows, self.firsts, p = [], [], 0
        for _ in range(blocks):
            n, *row = ROW.unpack_from(data, p)
            self.rows.append(row)
            self.firsts.append(data[p + ROW.size : p + ROW.size + n])
            p += ROW.size + n
        self.zstd = zstandard.ZstdDecompressor()

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, ids of the shard before it, value) of each entry."""
        at, size, entries, before = self.rows[i]
        stored = self._range(at, size)
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("damaged block")
        data, p, key = self.zstd.decompress(stored[:-4]), 0, b""
        for _ in range(entries):
            shared, p = _read_varint(data, p)
            fresh, p = _read_varint(data, p)
            length, p = _read_varint(data, p)
            key = key[:shared] + data[p : p + fresh]
            value = data[p + fresh : p + fresh + length]
            p += fresh + length
            yield key, before, value
            before += length // self.width

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for i in range(len(self.rows)):
            yield from self.block(i)

    def may_have(self, key: bytes) -> bool:
        at = _bloom_bits([key], 8 * len(self.bloom)).ravel().astype(np.int64)
        return bool((self.bloom[at >> 3] >> (7 - (at & 7)) & 1).all())

    def get(self, key: bytes) -> list[bytes]:
        """Values under a key; several where the identifier was repeated."""
        if not self.may_have(key):
            return []
        found = []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.firsts) and self.firsts[i] <= key:
            found += [v for k, _, v in self.block(i) if k == key]
            i += 1
        return found

    def close(self) -> None:
        self.file.close()


MANIFEST = "shard long, path string, first binary, last binary, n_docs long, n_ids long"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode and write all documents; returns the manifest, a row per shard in key order.

    docs: doc_id, text (other columns are ignored). Null text is empty; null identifiers sort first;
    repeated identifiers are all kept, next to each other, in the order of their texts' hashes.
    An empty table gives an empty manifest. Tasks are ranges of the order, by which repeated identifiers
    are spread by hash and row; a task closes a shard at shard_bytes and begins another, so what it holds
    of a shard (keys, index, filter) doesn't follow the range's size. The order is total, so a task that
    runs twice writes equal files.
    """

    def write(batches):
        from pyspark import TaskContext

        enc, part, number = encoder(tokenizer, CACHE_ENTRIES), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else int(end_id).to_bytes(enc.width, "little")
        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        while head is not None:
            path, first = f"{folder}/shard-{part:06d}-{number:04d}.sst", None
            with atomic_output(path) as file:
                w = Writer(file, enc.width)
                while head is not None and w.at < shard_bytes:
                    keys = [key_of(i) for i in head.column(0).to_pylist()]
                    first = keys[0] if first is None else first
                    for key, ids in zip(keys, enc.encode_many([t or "" for t in head.column(1).to_pylist()]), strict=True):
                        w.add(key, ids + end)
                    head = next(batches, None)
                w.finish()
            yield pa.RecordBatch.from_pylist(
                [{"shard": part << 20 | number, "path": path, "first": first, "last": w.keys[-1], "n_docs": len(w.keys), "n_ids": w.ids}],
                pa.schema([("shard", pa.int64()), ("path", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )
            number += 1

    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    ranged = (
        docs.select("doc_id", "text")
        .withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    return written(ranged.mapInArrow(write, MANIFEST), "sst-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry of the shards: doc_id, start (ids before it, over all shards), ids, width.

    Only the manifest, a row per shard, goes through one task to add up the shards before each.
    """
    before = F.coalesce(
        F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    number = (F.row_number().over(Window.orderBy("shard")) - 1).alias("number")
    shards = manifest.select("path", before.alias("before"), number)

    def read(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("width", pa.int32())])
        for batch in batches:
            for row in batch.to_pylist():
                r = Reader(row["path"])
                for i in range(len(r.rows)):
                    got = [(id_of(k), row["before"] + n, v, r.width) for k, n, v in r.block(i)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)  # noqa: B905
                r.close()

    n = max(1, manifest.count())
    return shards.repartitionById(n, "number").mapInArrow(read, "doc_id long, start long, ids binary, width int")


def lookup(manifest: DataFrame, doc_id: int) -> list[bytes]:
    """The ids stored for one identifier: shards by key range, then Bloom filter and binary search."""
    key = key_of(doc_id)
    found = []
    for row in manifest.where((F.col("first") <= F.lit(key)) & (F.col("last") >= F.lit(key))).orderBy("shard").collect():
        r = Reader(row["path"])
        found += [le32(v, r.width) for v in r.get(key)]
        r.close()
    return found


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids (end id 1) as shards, read the shards back, digest each entry."""
    import public_tokenizers

    folder = new_folder(spark, "sst")
    manifest = write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, folder)

    def digest(batches):
        for b in batches:
            ids = [le32(v, w) for v, w in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("start"), pa.array([len(v) // 4 for v in ids], pa.int64()), pa.array([zlib.crc32(v) for v in ids], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_shards(manifest).mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
