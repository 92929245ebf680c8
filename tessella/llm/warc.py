"""Web archives with a two-level capture index.

Archives are WARC 1.1 files of gzip members, one member per record. A capture is a `response` with
its payload, or, where an equal payload of at least REVISIT_BYTES is stored elsewhere, a `revisit`
that names the response and holds headers alone.

Pages are put in the order of their URL keys (host reversed, com,example)/) and page_id before they
are written, so a task's records, and its lines `key timestamp {json}` of the index, are one range
of the order. A task writes its lines as gzip blocks of BLOCK_LINES lines, and behind them the
sparse directory of its blocks: first and last key, offset, length. A root file of the same form
lists these index files. Both directories are searched in place, by reading single entries at
offsets: nobody holds them. A lookup binary-searches the root and the directory, reads one block by
its range, binary-searches its lines, and reads the record by its range. Lookups in the order of
keys find the next line in the block at hand and the next record behind the last one.

Files carry their attempt's own name and only the rows of committed attempts lead to them, so a
task that runs twice can't mix its files.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessella.llm.common import Scratch, atomic_output, new_folder, open_read, table

REVISIT_BYTES = 1000
BLOCK_LINES = 1000
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archive files are closed at about this size and the next one is begun.
FILE_BYTES = 256 << 20
#: A task writes about so many bytes of payload.
TASK_BYTES = 128 << 20


def url_key(url: str | None) -> str:
    """Sort key of a URL: reversed host, then path and query; scheme, port, user and fragment are left out."""
    text = (url or "").strip()
    try:
        u = urlsplit(text if "://" in text else f"//{text}")
        host = u.hostname or ""
    except ValueError:
        return "%20".join(text.lower().split())
    host = host.removeprefix("www.")
    path = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return "%20".join((",".join(reversed(host.split("."))) + ")" + path.lower()).split())


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    n = urn.strip("<>").rpartition(":")[2]
    return int(n) if n else None


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; the HTTP header tells the payload's length also where the payload is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[6:6] = [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields from its uncompressed bytes; the digest of a response is checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("damaged payload")
    return {
        "page_id": _page_id(h["WARC-Record-ID"]),
        "url": json.loads(f'"{h["WARC-Target-URI"]}"'),
        "payload_bytes": int(fields["Content-Length"]),
        "payload_digest": digest,
        "record_type": h["WARC-Type"],
        "refers_to": _page_id(h["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else payload,
    }


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
SHARD = "first_key string, first_page long, path string, entry string"


@F.pandas_udf(StringType())
def _key(urls: pd.Series) -> pd.Series:
    return urls.map(url_key)


def order(key: str, page_id: int | None) -> list:
    """Place of a capture in the index; a null page_id comes first."""
    return [key, 0, 0] if page_id is None else [key, 1, page_id]


def revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """key, page_id, digest, refers_to of the captures that are revisits. pages: key, page_id, digest, size.

    The response of equal payloads is found by an aggregation that combines before the shuffle and
    sends a row per repeated payload; the join back is salted, as one payload may be most rows.
    """
    large = pages.where(F.col("size") >= REVISIT_BYTES).select("key", "page_id", "digest")
    copies = (
        large.groupBy("digest")
        .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
        .where("n > 1 and refers_to is not null")
        .select(F.col("digest").alias("d"), "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    )
    salted = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = salted.join(scratch.write(copies, "copies"), (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("s")))
    again = joined.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("key", "page_id", "digest", "refers_to")
    return again.distinct()


class DirectoryWriter:
    """Entries (JSON) in order, then their offsets, then the number of entries and where the offsets begin."""

    def __init__(self, file, at: int):
        self.file, self.at, self.offsets = file, at, []

    def add(self, entry: str) -> None:
        data = entry.encode()
        self.file.write(data)
        self.offsets.append(self.at)
        self.at += len(data)

    def close(self) -> None:
        self.file.write(struct.pack(f"<{len(self.offsets) + 1}Q", *self.offsets, self.at))
        self.file.write(struct.pack("<QQ", len(self.offsets), self.at))


class Directory:
    """A written directory, searched in place."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        self.n, self.table = struct.unpack("<QQ", _range(file, end - 16, 16))

    def entry(self, i: int) -> dict:
        a, b = struct.unpack("<QQ", _range(self.file, self.table + 8 * i, 16))
        return json.loads(_range(self.file, a, b - a))

    def first_to_reach(self, place: list) -> int:
        """The first entry whose last place isn't before `place`; n if there is none."""
        return bisect.bisect_left(range(self.n), place, key=lambda i: self.entry(i)["last"])


class IndexWriter:
    """An index file: lines in order, in compressed blocks, and their directory."""

    def __init__(self, path: str):
        self.path, self.output = path, atomic_output(path)
        self.file = self.output.__enter__()
        self.at, self.blocks, self.lines, self.first, self.last = 0, [], [], None, None

    def add(self, place: list, line: str) -> None:
        self.first, self.last = self.first or place, place
        self.lines.append((place, line))
        if len(self.lines) == BLOCK_LINES:
            self.flush()

    def flush(self) -> None:
        if self.lines:
            data = gzip.compress(("\n".join(x for _, x in self.lines) + "\n").encode("utf-8", "surrogatepass"), 6, mtime=0)
            self.file.write(data)
            self.blocks.append(json.dumps({"first": self.lines[0][0], "last": self.lines[-1][0], "offset": self.at, "length": len(data)}))
            self.at += len(data)
            self.lines = []

    def close(self) -> tuple:
        """The row of SHARD."""
        self.flush()
        directory = DirectoryWriter(self.file, self.at)
        for b in self.blocks:
            directory.add(b)
        directory.close()
        self.output.__exit__(None, None, None)
        page = self.first[2] if self.first[1] else None
        return self.first[0], page, self.path, json.dumps({"first": self.first, "last": self.last, "path": self.path})


def archive(pages: DataFrame) -> str:
    """Write archives and index of all pages (page_id, url, html); returns the path of the index's root.

    Null html is an empty payload. Of equal payloads of at least REVISIT_BYTES that with the largest
    page_id is the response; rows that repeat this page_id are responses too, and without any
    page_id all are. A null page_id or url is kept as such. An empty table gives an empty root.
    The payloads are shuffled once: revisits come as short rows of their own into the same order.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    scratch = Scratch(spark, "warc")
    base = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    base = base.select(_key("url").alias("key"), "page_id", F.sha1("payload").alias("digest"), "url", "payload")
    size = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // TASK_BYTES))
    again = revisits(base.select("key", "page_id", "digest", F.length("payload").alias("size")), scratch)
    rows = base.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1))
    marks = again.select("key", "page_id", "digest", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "refers_to", F.lit(0).alias("kind"))
    by = ["key", "page_id", "digest"]
    dealt = rows.unionByName(marks).repartitionByRange(tasks, *by).sortWithinPartitions(*by, "kind")

    def write(batches):
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        index, number, mark = None, 0, None
        output, path, at = None, None, 0
        for b in batches:
            for key, page_id, digest, url, payload, refers_to, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not kind:
                    mark = (key, page_id, digest, refers_to)
                    continue
                revisit = mark is not None and mark[:3] == (key, page_id, digest)
                if output is None or at >= FILE_BYTES:
                    if output:
                        output.__exit__(None, None, None)
                    path, at = f"{folder}/archive-{name}-{number:04d}.warc.gz", 0
                    output, number = atomic_output(path), number + 1
                    file = output.__enter__()
                data = gzip.compress(build_record(page_id, url, payload, digest, mark[3] if revisit else None, revisit), 6, mtime=0)
                file.write(data)
                about = {"page_id": page_id, "digest": digest, "type": "revisit" if revisit else "response", "file": path, "offset": at, "length": len(data)}
                at += len(data)
                index = index or IndexWriter(f"{folder}/index-{name}.gz")
                index.add(order(key, page_id), f"{key} {DATE} {json.dumps(about)}")
        if output:
            output.__exit__(None, None, None)
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(index.close(), kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

    shards = scratch.write(dealt.select(*by, "url", "payload", "refers_to", "kind").mapInArrow(write, SHARD), "shards")

    def write_root(batches):
        path = f"{folder}/root-{uuid.uuid4().hex}"
        with atomic_output(path) as file:
            directory = DirectoryWriter(file, 0)
            for b in batches:
                for entry in b.column(0).to_pylist():
                    directory.add(entry)
            directory.close()
        yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    in_order = shards.orderBy("first_key", F.asc_nulls_first("first_page")).select("entry").coalesce(1)
    got = in_order.mapInArrow(write_root, "path string").collect()
    scratch.drop()
    if got:
        return got[0].path
    path = f"{folder}/root"  # no partition at all: an empty table
    with atomic_output(path) as file:
        DirectoryWriter(file, 0).close()
    return path


def _range(file, at: int, size: int) -> bytes:
    file.seek(at)
    return file.read(size)


class Lookup:
    """Finds captures by binary search in the files; holds one block of lines and two open files."""

    def __init__(self, root: str):
        self.root = Directory(open_read(root))
        self.shard, self.index, self.archive = None, None, None
        self.at, self.block = None, None

    def close(self) -> None:
        for f in (self.root.file, self.index and self.index.file, self.archive and self.archive[1]):
            if f:
                f.close()

    def _open(self, shard: int) -> None:
        if shard != self.shard:
            if self.index:
                self.index.file.close()
            self.shard, self.index = shard, Directory(open_read(self.root.entry(shard)["path"]))

    def _read(self, shard: int, i: int) -> None:
        self._open(shard)
        if (shard, i) != self.at:
            entry = self.index.entry(i)
            places, abouts = [], []
            for line in gzip.decompress(_range(self.index.file, entry["offset"], entry["length"])).decode("utf-8", "surrogatepass").split("\n")[:-1]:
                key, _, about = line.split(" ", 2)
                abouts.append(json.loads(about))
                places.append(order(key, abouts[-1]["page_id"]))
            self.at, self.block = (shard, i), (places, abouts)

    def _blocks_from(self, low: list) -> Iterator[tuple[list, list]]:
        """Blocks in order, from the first that reaches `low`. The directories are asked only outside the block at hand."""
        if self.block is None or not self.block[0][0] < low <= self.block[0][-1]:
            shard = self.root.first_to_reach(low)
            if shard == self.root.n:
                return
            self._open(shard)
            self._read(shard, self.index.first_to_reach(low))
        while True:
            yield self.block
            shard, i = self.at
            self._open(shard)
            if i + 1 < self.index.n:
                self._read(shard, i + 1)
            elif shard + 1 < self.root.n:
                self._read(shard + 1, 0)
            else:
                return

    def captures(self, low: list, high: list) -> Iterator[dict]:
        """What the index says of the captures from one place to another."""
        for places, abouts in self._blocks_from(low):
            yield from abouts[bisect.bisect_left(places, low) : bisect.bisect_right(places, high)]
            if places[-1] > high:
                return

    def record(self, about: dict) -> dict:
        if self.archive is None or self.archive[0] != about["file"]:
            if self.archive:
                self.archive[1].close()
            self.archive = (about["file"], open_read(about["file"]))
        return parse_record(zlib.decompress(_range(self.archive[1], about["offset"], about["length"]), 31))

    def find(self, url: str | None) -> list[dict]:
        """The records captured for a URL, payloads included."""
        key = url_key(url)
        return [self.record(x) for x in self.captures([key, 0, 0], [key, 2, 0])]


def find_captures(wanted: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """The captures of wanted (page_id, url), each found by search: FIELDS, and payload (null for revisits) if asked for.

    Repeated rows of wanted are asked once, and all captures with that page_id and URL key are
    returned; what isn't there gives no row. Requests are put in the order of the index, so a task
    reads a run of blocks and records. An empty table stays empty.
    """
    spark = wanted.sparkSession
    names = [c.split()[0] for c in FIELDS.split(", ")] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
    n = wanted.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 100_000)
    asked = wanted.select(_key("url").alias("key"), "page_id").distinct()

    def read(batches):
        lookup = Lookup(root)
        places = (order(*r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        rows, size = [], 0
        for place in places:
            for about in lookup.captures(place, place):
                r = lookup.record(about)
                rows.append([r[c] for c in names])
                size += r["payload_bytes"] + 200
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, size = [], 0
        lookup.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    dealt = asked.repartitionByRange(tasks, "key", "page_id").sortWithinPartitions("key", "page_id")
    return dealt.mapInArrow(read, FIELDS + ", payload binary" * payloads)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written, and each found again through the index."""
    pages = table(spark, sf_dir, "pages")
    return find_captures(pages.select("page_id", "url"), archive(pages), payloads=False).drop("url")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS bytes FROM pages),
r AS (SELECT html, max(page_id) AS response, count(*) AS n FROM p WHERE bytes >= 1000 GROUP BY html)
SELECT page_id, bytes AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN r.n > 1 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN r.n > 1 AND response <> page_id THEN response END AS refers_to
FROM p LEFT JOIN r ON r.html = p.html
"""
