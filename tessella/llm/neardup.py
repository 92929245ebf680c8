"""Near duplicates of whole texts by MinHash banding, signature verification, and connected components.

1. Each text becomes the set of its distinct word k-shingles, as 64-bit hashes; equal sets form a
   class, and from here on one row stands for a class (so copies cost nothing further).
2. Classes get minima of many universal hashes, in bands of `rows`; the number of bands follows
   from the threshold so that a pair at the threshold is missed with a chance of at most 1e-7. The
   minima's low bytes are the class's signature.
3. Classes that share a band are chained to the least of that bucket (never all pairs), and
   alternating large-star and small-star joins the chains into clusters. Two classes that are
   similar are in one cluster.
4. Within a cluster signatures are verified: a pair whose minima agree in fewer places than a pair
   at the threshold would show but for a chance of 1e-9, or whose sizes rule the threshold out, is
   no candidate. The stars over the candidates split the clusters.
5. Within what is left the full sets are compared, and the stars over those links are the answer.

Steps 4 and 5 work on blocks of bounded size: a cluster that is larger than a block is cut by size
of the sets, so that only equal and neighbouring sizes can meet the threshold, and then by hash.
Every pair of blocks is one group, so a cluster of any size splits, and only a spanning forest of
its links leaves a group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, join_checked, prepare, remove, table

MIX = np.uint64(0x9E3779B97F4A7C15)
MIX2 = np.uint64(0xBF58476D1CE4E5B9)
#: Rows of a side that is broadcast: two longs each, so at most some 16 MB.
BROADCAST_ROWS = 500_000
#: Shingles of a block in the exact comparison (8 bytes each).
BLOCK_SHINGLES = 500_000
#: Signatures of a block in the verification (some 200 bytes each).
BLOCK_SIGNATURES = 10_000
WORD_CACHE = 150_000
#: Parts of a node's neighbours in the star joins.
SALTS = 8


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hash = _WordHash()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * MIX2
    return h ^ (h >> np.uint64(27))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word k-shingles; ASCII capitals count as small letters.

    Words are runs of anything but ASCII white space. With fewer than k words the whole sequence is
    the only shingle; without a word, and for null, the set is empty.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, n)
    width = min(k, n)
    with np.errstate(over="ignore"):
        out = h[: n - width + 1] + np.uint64(width)
        for j in range(1, width):
            out = out * MIX + h[j : n - width + 1 + j]
        return np.unique(_mix(out))


def band_count(rows: int, threshold: float, miss: float = 1e-7) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))


def least_matches(places: int, threshold: float, miss: float = 1e-9) -> int:
    """The most places t such that a pair at the threshold agrees in fewer than t with a chance of at most miss."""
    below = 0.0
    for t in range(places + 1):
        below += math.comb(places, t) * threshold**t * (1 - threshold) ** (places - t)
        if below > miss:
            return t
    return places


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min over the set of a * x + b modulo 2**32, for each (a, b)."""
    x32 = (x >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x32), 2048):
        v = a[:, None] * x32[None, at : at + 2048]
        v += b[:, None]
        np.minimum(out, v.min(axis=1), out=out)
    return out


SIGNATURE = "doc_id long, n long, d1 long, d2 long, bands array<long>, signature binary"


def signatures(docs: DataFrame, k: int, rows: int, bands: int, seed: int = 1) -> DataFrame:
    """A row per document: size of its set, 128-bit digest of the set, a hash for each band, low bytes of the minima."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, rows * bands, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint64).astype(np.uint32)
    salt = rng.integers(0, 1 << 63, bands, dtype=np.uint64)

    def sign(batches):
        for batch in batches:
            n, digests, hashes, sizes, low = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    with np.errstate(over="ignore"):
                        least = minima(s, a, b)
                        m = least.astype(np.uint64).reshape(bands, rows)
                        h = salt.copy()
                        for j in range(rows):
                            h = _mix(h * MIX + m[:, j])
                    hashes.append(h.view(np.int64))
                low.append(least.astype(np.uint8).tobytes() if len(s) else b"")
                sizes.append(bands if len(s) else 0)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]),
                    pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), flat),
                    pa.array(low, pa.binary()),
                ],
                names=["doc_id", "n", "d1", "d2", "bands", "signature"],
            )
        _word_hash.clear()  # the worker lives on, and its memory serves what comes next

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


# ---- connected components -----------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, rounds: int = 50) -> DataFrame:
    """Alternating large-star and small-star over edges (u, v): rows (u, v), v the least of u's component.

    Least nodes themselves have no row. Each node's least neighbour comes from an aggregation that
    combines before the shuffle, and is joined back by the node and a salt: so a node with very many
    neighbours is SALTS tasks' work, and as the join has shuffles of its own on both sides, adaptive
    execution splits it further. Tables of past rounds go.
    """
    own = Scratch(scratch.spark, f"{scratch.label}-stars")

    def with_least(pairs, least):
        salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = own.write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = state(e)
    for i in range(rounds):
        if not before[0]:
            break
        past, own.paths = own.paths, []
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = own.write(large.where("u <> v").distinct(), f"large{i}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = own.write(small.union(least.select("u", F.col("m").alias("v"))).distinct(), f"small{i}")
        for path in past + own.paths[:-1]:
            remove(own.spark, path)
        own.paths = own.paths[-1:]
        if (after := state(e)) == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    scratch.paths += own.paths
    return e


# ---- blocks of clusters -------------------------------------------------------------------


def spread(members: DataFrame, weight: Column, per_block: int, num: int, den: int, scratch: Scratch) -> DataFrame:
    """members (c, m, n, and more) with g, lo, hi, side: a row for each group of blocks that a member is in.

    A cluster c of at most per_block by weight is one group. A larger one is cut into classes of the
    size n, wide enough that sets which meet the threshold are in the same class or in neighbours
    (den * min >= num * max), and these by hash into blocks; g is even for pairs of blocks of a
    class, odd for a class (side 0) and the next.
    """
    step = math.log(den / num) * (1 + 1e-9)
    s = F.floor(F.log("n") / step).cast("int") if step else F.col("n").cast("int")
    classed = members.withColumn("s", s)
    by_class = classed.groupBy("c", "s").agg(F.sum(weight).alias("w"))
    blocks = F.map_from_entries(F.collect_list(F.struct("s", F.ceil(F.col("w") / per_block).cast("int"))))
    # a cluster has some dozens of size classes, each one entry
    plan = scratch.write(by_class.groupBy("c").agg((F.sum("w") <= per_block).alias("whole"), blocks.alias("blocks")), "blocks")

    def pairs(other: Column, row: Callable[[Column], list[Column]]) -> Column:
        n = F.coalesce(F.element_at("blocks", other), F.lit(0))
        none = F.array().cast("array<struct<g:int,lo:int,hi:int,side:int>>")
        made = lambda o: F.struct(*[x.cast("int").alias(a) for a, x in zip(("g", "lo", "hi", "side"), row(o), strict=True)])
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), made)).otherwise(none)

    s, b, zero = F.col("s"), F.col("b"), F.lit(0)
    own = pairs(s, lambda o: [s * 2, F.least(b, o), F.greatest(b, o), (b > o)])
    up = pairs(s + 1, lambda o: [s * 2 + 1, b, o, zero])
    down = pairs(s - 1, lambda o: [s * 2 - 1, o, b, F.lit(1)])
    one = F.array(F.struct(F.lit(-2).alias("g"), zero.alias("lo"), zero.alias("hi"), zero.alias("side")))
    return (
        classed.join(plan, "c")
        .withColumn("b", F.pmod(F.xxhash64("m"), F.element_at("blocks", s)).cast("int"))
        .withColumn("p", F.explode(F.when(F.col("whole"), one).otherwise(F.concat(own, up, down))))
        .select(*members.columns, "p.*")
    )


def forest(pairs) -> Iterator[tuple[int, int]]:
    """Links that connect what the pairs connect: fewer than there are nodes."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for u, v in pairs:
        a, b = find(int(u)), find(int(v))
        if a != b:
            root[a] = b
            yield int(u), int(v)


def links_in_groups(dealt: DataFrame, payload: str, find) -> DataFrame:
    """Links (u, v) that find(ids, sizes, side, payloads, cross) makes of each group of `spread`; a task holds one group."""

    def run(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (_, g, lo, hi), group in groupby(rows, lambda r: r[:4]):
            side, ids, n, data = map(list, zip(*(r[4:] for r in group), strict=True))
            if len(ids) > 1:
                got = list(forest(find(np.array(ids), np.array(n), np.array(side), data, g % 2 == 1 or lo != hi)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], names=["u", "v"])

    key = ["c", "g", "lo", "hi"]
    return dealt.select(*key, "side", "m", "n", payload).repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u long, v long")


def candidates(places: int, num: int, den: int):
    """For links_in_groups: pairs that signatures and sizes don't rule out, by breadth from each set."""
    enough = least_matches(places, num / den)

    def find(ids, n, side, signatures, cross):
        sig = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(ids), places)

        def agree(x, rest):
            rest = rest[den * np.minimum(n[rest], n[x]) >= num * np.maximum(n[rest], n[x])]
            return rest[(sig[rest] == sig[x]).sum(axis=1) >= enough]

        if cross:
            right = np.flatnonzero(side == 1)
            for x in np.flatnonzero(side == 0):
                for y in agree(x, right):
                    yield ids[x], ids[y]
            return
        left = np.ones(len(ids), bool)
        for start in range(len(ids)):
            queue = [start] if left[start] else []
            left[start] = False
            while queue:
                x = queue.pop()
                for y in agree(x, np.flatnonzero(left)):
                    yield ids[x], ids[y]
                    queue.append(y)
                    left[y] = False

    return find


# ---- exact comparison ---------------------------------------------------------------------


def _link_block(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], num: int, den: int, cross: bool):
    """Spanning links of the graph `den * |A & B| >= num * |A | B|` on these sets.

    cross: only pairs of different sides. A set so many of whose shingles occur nowhere else here
    that it can't reach the threshold is left out first; from the others the components grow by
    breadth, each set being held only against those not yet in its component.
    """
    keep = np.arange(len(sets))
    while True:
        sizes = np.array([len(sets[i]) for i in keep], np.int64)
        if len(keep) < 2:
            return
        _, t = np.unique(np.concatenate([sets[i] for i in keep]), return_inverse=True)
        owner = np.repeat(np.arange(len(keep)), sizes)
        alone = np.bincount(owner, weights=np.bincount(t)[t] == 1, minlength=len(keep)).astype(np.int64)
        ok = den * (sizes - alone) >= num * sizes
        if ok.all():
            break
        keep = keep[ok]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(int(t.max()) + 1, bool)

    def similar(x: int, rest: np.ndarray, rest_t: np.ndarray, rest_owner: np.ndarray) -> np.ndarray:
        mine = t[starts[x] : starts[x + 1]]
        mark[mine] = True
        common = np.bincount(rest_owner, weights=mark[rest_t], minlength=len(rest)).astype(np.int64)
        mark[mine] = False
        return den * common >= num * (sizes[x] + sizes[rest] - common)

    def gather(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(rest):
            return t[:0], owner[:0]
        return np.concatenate([t[starts[i] : starts[i + 1]] for i in rest]), np.repeat(np.arange(len(rest)), sizes[rest])

    ids, side = ids[keep], side[keep]
    if cross:
        rest = np.flatnonzero(side == 1)
        rest_t, rest_owner = gather(rest)
        if len(rest):
            for x in np.flatnonzero(side == 0):
                for y in rest[similar(x, rest, rest_t, rest_owner)]:
                    yield ids[x], ids[y]
        return
    rest = np.arange(len(keep))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        rest_t, rest_owner = gather(rest)
        while queue and len(rest):
            x = queue.pop()
            hit = similar(x, rest, rest_t, rest_owner)
            if hit.any():
                for y in rest[hit]:
                    yield ids[x], ids[y]
                    queue.append(y)
                rest = rest[~hit]
                rest_t, rest_owner = gather(rest)


def confirmed(num: int, den: int):
    """For links_in_groups: pairs that meet the threshold on their full sets."""

    def find(ids, n, side, sets, cross):
        yield from _link_block(ids, side, [np.frombuffer(x, np.uint64) for x in sets], num, den, cross)

    return find


def near_duplicates(
    docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, rows: int = 6, seed: int = 1
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when den * |A & B| >= num * |A | B| for their sets of word k-shingles;
    component_id is the least doc_id that links reach, and kept says that it's the document's own.
    Null and wordless texts have an empty set, are linked with nothing and are kept. Rows that
    repeat a doc_id count as one document: they share a component, and are kept alike. A null
    doc_id is linked with nothing and kept. Columns besides the two are ignored.
    """
    scratch = Scratch(docs.sparkSession, "neardup")
    prepare(docs.sparkSession)
    bands = band_count(rows, num / den)
    sig = scratch.write(signatures(docs, k, rows, bands, seed), "sig")
    classes = scratch.write(
        sig.where("n > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("m"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "classes",
    )
    keys = classes.select("m", F.explode("bands").alias("key"))
    buckets = scratch.write(
        keys.groupBy("key").agg(F.min("m").alias("c"), F.max("m").alias("last")).where("c < last").select("key", "c"), "buckets"
    )
    chains = join_checked(keys, buckets, "key", "inner", BROADCAST_ROWS).where("m <> c")
    coarse = components(chains.select(F.col("m").alias("u"), F.col("c").alias("v")), scratch)
    drawn = join_checked(classes.select("m", "n", "signature"), membership(coarse, scratch), "m", "inner", BROADCAST_ROWS)
    dealt = spread(drawn, F.lit(1), BLOCK_SIGNATURES, num, den, scratch)
    likely = components(links_in_groups(dealt, "signature", candidates(rows * bands, num, den)), scratch)
    cluster = membership(likely, scratch)

    def full_sets(batches):
        for b in batches:
            sets = [shingle_set(text, k) for text in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["m", "c", "n", "shingles"],
            )

    texts = docs.select(F.col("doc_id").alias("m"), "text")
    sets = scratch.write(
        join_checked(texts, cluster, "m", "inner", BROADCAST_ROWS)
        .select("m", "c", "text")
        .mapInArrow(full_sets, "m long, c long, n long, shingles binary")
        .where("n > 0"),
        "sets",
    )
    dealt = spread(sets, F.col("n"), BLOCK_SHINGLES, num, den, scratch)
    links = components(links_in_groups(dealt, "shingles", confirmed(num, den)), scratch)
    answer = (
        classes.select("d1", "d2", "m", "copies")
        .join(links.select(F.col("u").alias("m"), F.col("v").alias("root")), "m", "left")
        .where("copies > 1 or root is not null")
        .select("d1", "d2", F.coalesce("root", "m").alias("component"))
    )
    answer = scratch.write(answer, "answer")
    component = F.when((F.col("n") > 0) & F.col("component").isNotNull() & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    result = (
        join_checked(sig.select("doc_id", "n", "d1", "d2"), answer, ["d1", "d2"], "left", BROADCAST_ROWS)
        .select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
    result = Scratch(scratch.spark, scratch.label).write(result, "result")
    scratch.drop()
    return result


def membership(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """(m, c) for every node of components, the least ones included."""
    least = stars.select(F.col("v").alias("m"), F.col("v").alias("c")).distinct()
    return scratch.write(stars.select(F.col("u").alias("m"), F.col("v").alias("c")).union(least), "clusters")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 3-word shingles, links at a likeness of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(c.least, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.x = d.doc_id
"""
