"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two that make up n
(pieces of the maximum length first, then the binary digits of the rest, longest first). Each piece
is a sequence by itself, and sequences of equal length share a bucket: a batch is drawn from one
bucket, needs no padding, and no sequence holds two documents.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import prepare, table
from tessella.llm.tokens import encoder, le32

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"
)
#: A sequence's number: bucket, partition and running number, so that equal lengths are one range.
PARTITION_BITS, ROW_BITS = 22, 34


def piece_lengths(n: int, longest: int) -> list[int]:
    """The powers of two, none above `longest` (itself one), that n is made of."""
    out = [longest] * (n // longest)
    rest, bit = n % longest, longest >> 1
    while rest:
        if rest & bit:
            out.append(bit)
            rest -= bit
        bit >>= 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int | None, longest: int = 1024) -> DataFrame:
    """A row per piece of every row of docs (doc_id, text; other columns are ignored).

    ids are little-endian 32-bit integers; bucket is the logarithm of the piece's length, to base 2.

    Null text is empty, so such a document is its end token alone (or nothing without one).
    Repeated rows and repeated identifiers are packed once per row. sequence_id is unique, and the
    same each time the same partitions are read. There is no shuffle, and a task holds one batch.
    """
    if longest & longest - 1 or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    prepare(docs.sparkSession)

    def cut(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else int(end_id).to_bytes(enc.width, "little")
        used = [0] * longest.bit_length()
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = le32(ids + end, enc.width)
                at, total = 0, len(ids) // 4
                for n in piece_lengths(total, longest):
                    bucket = n.bit_length() - 1
                    number = (bucket << PARTITION_BITS + ROW_BITS) + (part << ROW_BITS) + used[bucket]
                    used[bucket] += 1
                    rows.append((doc_id, at, n, total, bucket, number, 0, ids[at * 4 : (at + n) * 4]))
                    at += n
                if len(rows) > 5_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, a folder per bucket, whose sequences have one length. Nothing is written for an empty bucket."""
    packed.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length; other folders aren't opened."""
    return spark.read.schema(PIECES).parquet(path).where(F.col("bucket") == length.bit_length() - 1)


def digest(packed: DataFrame) -> DataFrame:
    """Pieces with the crc32 of their ids in place of the ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, end id 0, sequences of at most 1024 tokens."""
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0, 1024))
