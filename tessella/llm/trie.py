"""Conversations as a trie of shared prefixes, with counts and sums over every subtree.

A prefix of d turns is known by a chained digest: SHA-256 of the digest of the first d - 1 turns and
of the d-th turn's content. Equal digests stand for equal prefixes, so grouping all prefixes by
(depth, digest) gives the trie's nodes; a node's label is its smallest conversation and its depth.

Along a conversation, from some depth on it is the smallest member of every node: these nodes are
its tail, and each node lies in exactly one tail. Whatever a tail holds counts for every ancestor
above it alike, so sums over subtrees take two steps: running sums inside each tail, from the leaf up,
and one row per tail for each of the ancestors above (an explosion no larger than the prefixes are).

Nothing is gathered per node. A node's conversations that end there are hashed as a sorted stream
of their numbers, cut into chunks before they meet; parents with more than a thousandth of all nodes
as children are at most a thousand, and these alone are broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, table, written

ROOT = hashlib.sha256(b"").digest()
PREFIXES = "conv_id long, depth long, digest binary, parent binary, size long, last boolean"
#: Bytes of a chunk of conversation numbers; rows of an Arrow batch that is sent back.
CHUNK, ROWS = 1 << 16, 10_000
#: A parent is hot if its children are more than one of so many nodes; there are no more such parents than this.
HOT = 1000


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), said (digest of role and text), size (code points of the text).

    Turns go by turn, null first, ties by role and text; null role and null text are empty, repeated rows
    are turns of their own. Rows with a null conv_id belong to no conversation and are left out;
    other columns are ignored.
    """
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    said = F.unhex(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256))
    return (
        conversations.where("conv_id is not null")
        .select("conv_id", "turn", *empty)
        .select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), said.alias("said"), F.char_length("text").cast("long").alias("size"))
    )


def grafted(turns: DataFrame, among: int = 100, most: int = 6) -> DataFrame:
    """Conversations whose first turns are another one's: c takes the first h turns of c - c % among.

    h is crc32 of c's decimal digits, modulo `most`. c keeps its own turns after its first h. There is a row
    with pos -1 for each conversation, so that one without turns is there too.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    ids = turns.select("conv_id").distinct()
    nothing = (F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("said"), F.lit(0).cast("long").alias("size"))
    heads = turns.where((F.col("conv_id") % among == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv_id", "base")
    taken = ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % among).join(heads, "base").where(F.col("pos") < h)
    own = turns.where(F.col("pos") >= h)
    return ids.select("conv_id", *nothing).unionByName(own).unionByName(taken.drop("base"))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def chained(turns: DataFrame) -> DataFrame:
    """Every prefix of every conversation, the empty one included, as PREFIXES.

    turns: conv_id, pos, said, size, and a row with pos -1 for each conversation. Tasks read sorted rows and
    hold two of them, however long a conversation is.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("size", pa.int64()), ("last", pa.bool_())])

    def walk(batches):
        def prefixes():
            for conv, rows in groupby(_rows(batches), itemgetter(0)):
                next(rows)
                depth, above, digest, size = 0, None, ROOT, 0
                for _, _, said, n in rows:
                    yield conv, depth, digest, above, size, False
                    depth, above, digest, size = depth + 1, digest, hashlib.sha256(digest + said).digest(), n
                yield conv, depth, digest, above, size, True

        yield from _batches(prefixes(), schema)

    dealt = turns.select("conv_id", "pos", "said", "size").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return dealt.mapInArrow(walk, PREFIXES)


def ends(prefixes: DataFrame) -> DataFrame:
    """digest, ends_sha256: SHA-256 of the comma-joined ascending numbers of the conversations that end at a node."""
    chunks = pa.schema([("digest", pa.binary()), ("first", pa.int64()), ("ids", pa.binary())])
    hashes = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])

    def join(batches):
        def cut():
            for digest, rows in groupby(_rows(batches), itemgetter(0)):
                first, held = None, bytearray()
                for _, conv in rows:
                    first = conv if first is None else first
                    held += b"%d," % conv
                    if len(held) >= CHUNK:
                        yield digest, first, bytes(held)
                        first, held = None, bytearray()
                if held:
                    yield digest, first, bytes(held)

        yield from _batches(cut(), chunks)

    def digest_of(batches):
        def hashed():
            for digest, rows in groupby(_rows(batches), itemgetter(0)):
                h, before = hashlib.sha256(), b""
                for _, _, ids in rows:
                    h.update(before + ids[:-1])
                    before = b","
                yield digest, h.hexdigest()

        yield from _batches(hashed(), hashes)

    last = prefixes.where("last").select("digest", "conv_id")
    cut = last.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(join, "digest binary, first long, ids binary")
    return cut.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(digest_of, "digest binary, ends_sha256 string")


def parents_of(tops: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(depth, digest, parent_conv_id) of nodes whose parent lies in another tail.

    tops: depth, digest, parent; nodes: depth, digest, conv_id, n_children.
    """
    labels = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    total = nodes.count()
    hot = F.broadcast(labels.where(F.col("n_children") * HOT > total).drop("n_children"))
    on = ["depth", "parent"]
    near = tops.join(hot, on)
    far = tops.join(hot, on, "left_anti").join(labels.drop("n_children"), on)
    return near.unionByName(far).select("depth", "digest", "parent_conv_id")


def trie(turns: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns: as `chained` takes them. No conversation at all gives no node.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "trie")
    key = ["depth", "digest"]
    prefixes = scratch.write(chained(turns), "prefixes")
    nodes = prefixes.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.first("parent").alias("parent"))
    nodes = scratch.write(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    w = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    down = w.rowsBetween(Window.unboundedPreceding, 0)
    tails = (
        nodes.join(children, key, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        .withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("size"))
        .select("conv_id", *key, "parent", "n_convs", "n_children", F.lead("depth").over(w).isNull().alias("top"), F.sum("leaf").over(down).alias("leaves"), F.sum("saved").over(down).alias("saves"))
    )
    tails = scratch.write(tails, "tails")
    tops = tails.where("top")
    held = tops.select("conv_id", F.col("depth").alias("from"), F.col("leaves").alias("given"), F.col("saves").alias("gift"))
    above = prefixes.join(held, "conv_id").where(F.col("depth") < F.col("from"))
    gifts = above.groupBy(*key).agg(F.sum("given").alias("given"), F.sum("gift").alias("gift"))
    labels = parents_of(tops.where("depth > 0").select(*key, "parent"), tails, scratch)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    zero = F.lit(0).cast("long")
    out = (
        tails.join(gifts, key, "left")
        .join(labels, key, "left")
        .join(ends(prefixes), "digest", "left")
        .select(
            "conv_id", "depth", F.when(F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs", "n_children", (F.col("leaves") + F.coalesce("given", zero)).alias("n_leaves"),
            (F.col("saves") + F.coalesce("gift", zero)).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
        )
    )
    out = written(out, "trie")
    scratch.drop()
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of its hundred's first one."""
    return trie(grafted(ordered_turns(table(spark, sf_dir, "conversations"))))


# crc32 of the decimal digits: reflected polynomial 0xEDB88320, eight steps a byte
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT),
  lambda c, b: list_reduce([xor(c, b)] || range(8), lambda x, i: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END)::BIGINT)), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos < h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
l AS (SELECT c.conv_id, coalesce(list({{'r': role, 'x': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS said FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL),
p AS (SELECT conv_id, said, unnest(range(len(said) + 1)) AS depth FROM l),
q AS (SELECT conv_id, depth, said[1:depth] AS path, depth = len(said) AS ended FROM p),
n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, CASE WHEN depth > 0 THEN length(path[depth].x) ELSE 0 END AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM q GROUP BY depth, path),
k AS (SELECT depth - 1 AS depth, path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, path)),
s AS (
  SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size)::BIGINT AS saved_tokens
  FROM m a JOIN (SELECT depth, n_children, n_convs, size, path, unnest(range(depth + 1)) AS up FROM m) b ON a.depth = b.up AND a.path = b.path[1:b.up] GROUP BY a.depth, a.path)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, path) LEFT JOIN m u ON u.depth = m.depth - 1 AND u.path = m.path[1:m.depth - 1]
"""
