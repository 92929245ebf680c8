"""Modified Kneser-Ney models of a corpus' byte n-grams, counted and held in shards.

An n-gram is ORDER bytes of UTF-8 in a row, case, signs and line ends included, so its code is exact
(48 bits, and one for the half) and the model grows with the corpus and its scripts. A code has the
context's bytes from the nearest to the farthest, then the last byte, so n-grams with like contexts
are neighbours. All languages share a model: five bytes tell them apart, and a passage in another language than its document's
is scored by what is known of that language.
A document can't vouch for itself: documents fall into two halves by a hash of the text (copies into
the same one), and each half is scored by the model that has learned from the other. No task
holds a model, the counts or a list of all n-grams:

1. Tasks cut their texts into blocks and send each block's distinct n-grams, with their counts in
   the documents to learn from, to shards. A shard is a hash of the last two bytes of the
   context, so whatever orders 3 to ORDER need of each other lies in one shard.
2. Shards merge these lists as a stream, write the merged counts and the blocks' n-grams, and send on
   the counts of counts and their part of the bigrams' counts. Those are at most 65,536 a half:
   orders 1 and 2 and the discounts come from them at the driver.
3. Shards work out interpolated probabilities, write them as sorted hash arrays, find each block's
   n-grams there by binary search and send log probabilities, to 1/2000, back to the block's file.
4. The texts are read again and each block takes its n-grams' values from its file.
"""

from __future__ import annotations

import io
import math
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, atomic_output, new_folder, open_read, release

ORDER = 6
#: The lowest order that a shard works out alone.
LOCAL = 3
#: Bytes of text in a block, bytes of a text coded at once, n-grams that a merge holds unsorted.
BLOCK, PIECE, PENDING = 5_000_000, 1 << 20, 2_000_000
#: N-grams whose codes a block holds before it sorts them, and the pieces that these are of at most.
RUN, PIECE_BITS = 1_000_000, 15
PIECES = 1 << PIECE_BITS
#: Log probabilities are sent back in steps of 1 / STEPS, in 16 bits: what is below -32.7 counts as that.
STEPS = 2000
#: Bytes before a text's first.
START = b"\n" * (ORDER - 1)

U = np.uint64
#: The bit of a code that tells the half; a model goes by the half that it scores.
HALF = U(1 << 63)
SENT = "shard int, block long, grams binary, n binary"
#: A block's number: its task's, and its own in the task.
BLOCK_BITS = 32


def half_of(data: bytes) -> int:
    return zlib.crc32(data) & 1


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Codes of a text's n-grams, one per byte, in pieces."""
    high = U(half_of(data) << 63)
    for at in range(0, len(data), PIECE):
        b = np.frombuffer((START + data[:PIECE]) if not at else data[at - ORDER + 1 : at + PIECE], np.uint8)
        n = len(b) - ORDER + 1
        code = b[ORDER - 1 :] | high
        for j in range(ORDER - 1):
            code |= b[j : n + j].astype(U) << U(8 * (j + 1))
        yield code


def tail(code: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of n-grams, with the half; the context's farther bytes are 0."""
    far = (1 << 8 * ORDER) - (1 << 8 * (ORDER - k + 1))
    return code & (HALF | U(far) | U(255))


def context(code: np.ndarray) -> np.ndarray:
    return code & ~U(255)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64 bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(31))) * U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
        return x ^ (x >> U(32))


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    """shards: a power of two. Both halves of an n-gram are in one shard."""
    return (mixed(context(tail(code, LOCAL)) & ~HALF) & U(shards - 1)).astype(np.int32)


# ---- the model's arithmetic ---------------------------------------------------------------


def total_by_code(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes ascending, and the sums of their numbers."""
    at = np.argsort(code, kind="stable")
    code, n = code[at], n[at]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(first) else n


def extensions(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From distinct n-grams of order k + 1: those of order k, and how many different bytes come before each."""
    t = tail(code, k)
    return total_by_code(t, np.ones(len(t), np.int64))


def discounts(c: np.ndarray) -> np.ndarray:
    """0, D1, D2, D3+ from how many n-grams occur once to four times; where one is 0, what leaves every count positive."""
    if not c.all():
        return np.array([0, 0.5, 0.75, 0.9])
    y = c[0] / (c[0] + 2 * c[1])
    d = [1 - 2 * y * c[1] / c[0], 2 - 3 * y * c[2] / c[1], 3 - 4 * y * c[3] / c[2]]
    return np.concatenate([[0], np.clip(d, 0.05, [0.95, 1.9, 2.9])])


def halves(code: np.ndarray) -> list[tuple[int, slice]]:
    """Where the codes of each half are, of those that have some. code is ascending."""
    cut = int(np.searchsorted(code, HALF))
    return [(h, at) for h, at in ((0, slice(0, cut)), (1, slice(cut, len(code)))) if len(code[at])]


def estimate(counts: dict, discount: dict, below: tuple[np.ndarray, np.ndarray] | None) -> dict:
    """Per order: codes, interpolated probabilities, contexts, back-off weights.

    counts: order to (codes ascending, counts). discount: (order, half) to four numbers.
    below: codes and probabilities of the order under the lowest; None stands for equal ones.
    """
    out = {}
    for k in sorted(counts):
        code, n = counts[k]
        ctx, at = np.unique(context(code), return_inverse=True)
        d = np.zeros(len(code))
        for half, own in halves(code):
            d[own] = discount[k, half][np.minimum(n[own], 3)]
        total = np.bincount(at, n, len(ctx))
        back = np.bincount(at, d, len(ctx)) / np.maximum(total, 1)
        lower = 1 / 256 if below is None else below[1][np.searchsorted(below[0], tail(code, k - 1))]
        below = (code, (n - d) / total[at] + back[at] * lower)
        out[k] = (*below, ctx, back)
    return out


class Model:
    """Sorted hash arrays: per order the n-grams' hashes ascending with log probabilities, and contexts' with log weights."""

    def __init__(self, orders: dict):
        self.arrays = {}
        for k, (code, p, ctx, back) in orders.items():
            for name, x, v in (("p", code, p), ("b", ctx, back)):
                h = mixed(x ^ U(k))
                at = np.argsort(h)
                self.arrays[f"{name}{k}"] = h[at]
                self.arrays[f"{name}{k}v"] = np.log(v[at]).astype(np.float32)

    def save(self, uri: str) -> None:
        with atomic_output(uri) as f:
            f.write(_npz(self.arrays))

    @staticmethod
    def load(uri: str) -> Model:
        m = Model({})
        m.arrays = _read_npz(uri)
        return m

    def find(self, name: str, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each code is there, and its value."""
        h, v = self.arrays.get(f"{name}{k}"), self.arrays.get(f"{name}{k}v")
        if h is None or not len(h):
            return np.zeros(len(code), bool), np.zeros(len(code), np.float32)
        want = mixed(code ^ U(k))
        at = np.minimum(np.searchsorted(h, want), len(h) - 1)
        return h[at] == want, v[at]

    def log_probability(self, code: np.ndarray) -> np.ndarray:
        """log P(last byte | those before it), from the highest order down; without a model all bytes are alike."""
        out = np.zeros(len(code), np.float32)
        left = np.arange(len(code))
        for k in range(ORDER, 0, -1):
            own = tail(code[left], k)
            hit, v = self.find("p", own, k)
            out[left[hit]] += v[hit]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return out
            hit, v = self.find("b", context(own), k)
            out[left] += np.where(hit, v, 0)
        out[left] -= np.float32(math.log(256))
        return out


def _npz(arrays: dict) -> bytes:
    f = io.BytesIO()
    np.savez(f, **arrays)
    return f.getvalue()


def _read_npz(uri: str) -> dict:
    with open_read(uri) as f, np.load(io.BytesIO(f.read())) as z:
        return dict(z)


# ---- blocks and shards --------------------------------------------------------------------


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane: high bytes are mostly 0."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def packed_values(x: np.ndarray) -> bytes:
    """16-bit numbers, the low bytes, then the high ones, which are much alike."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u2").view(np.uint8).reshape(-1, 2).T).tobytes(), 1)


def unpacked_values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(2, -1)
    return np.ascontiguousarray(planes.T).view("<u2").ravel()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


class Block:
    """Pieces of texts in a row: their n-grams, and which document each piece is of.

    Every RUN of codes is sorted, with the piece's number in the bits that a code leaves free: sorting takes a quarter of
    the time of a hash table. A block then holds two bytes a position, and what distinct codes take.
    """

    def __init__(self):
        self.size, self.held, self.runs, self.codes, self.doc, self.learn = 0, 0, [], [], [], []

    def add(self, doc: int, codes: np.ndarray, learn: bool) -> None:
        self.size += len(codes)
        self.held += len(codes)
        self.codes.append(codes)
        self.doc.append(doc)
        self.learn.append(learn)
        if self.held >= RUN or len(self.codes) == PIECES:
            self._close_run()

    def _close_run(self) -> None:
        """A run becomes: distinct codes, their numbers in all and in pieces to learn from, pieces by code, pieces' lengths, documents."""
        if not self.codes:
            return
        length = np.array([len(c) for c in self.codes], np.int64)
        code = np.concatenate(self.codes)
        code = (code & HALF) | ((code & ~HALF) << U(PIECE_BITS)) | np.repeat(np.arange(len(length), dtype=U), length)
        code.sort()
        piece = (code & U(PIECES - 1)).astype(np.uint16)
        code = (code & HALF) | ((code & ~HALF) >> U(PIECE_BITS))
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        n = np.add.reduceat(np.array(self.learn, np.int32)[piece], first)
        self.runs.append([code[first], np.diff(first, append=len(code)).astype(np.int32), n, piece, length, self.doc])
        self.held, self.codes, self.doc, self.learn = 0, [], [], []

    def distinct(self, shards: int) -> None:
        """self.sent: distinct n-grams by shard, ascending in each; self.n: their numbers in documents to learn from."""
        self._close_run()
        code, place = np.unique(np.concatenate([r[0] for r in self.runs]), return_inverse=True)
        n = np.bincount(place, np.concatenate([r[2] for r in self.runs]), len(code)).astype(np.int64)
        shard = shard_of(code, shards)
        order = np.argsort(shard, kind="stable")
        self.sent, self.shard, self.n = code[order], shard[order], n[order]
        back = np.empty(len(code), np.int32)
        back[order] = np.arange(len(code), dtype=np.int32)
        place, begin = back[place], 0
        for r in self.runs:
            r[0], r[2], begin = place[begin : begin + len(r[0])], None, begin + len(r[0])

    def lists(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Per shard: the block's n-grams, as differences, and their numbers in documents to learn from."""
        shards, first = np.unique(self.shard, return_index=True)
        for s, code, m in zip(shards, np.split(self.sent, first[1:]), np.split(self.n, first[1:]), strict=True):
            yield int(s), packed(np.diff(code, prepend=U(0))), packed(m)

    def scores(self, values: np.ndarray) -> Iterator[tuple[int, float, int]]:
        """Per piece: document, sum of -log P in steps, bytes."""
        for place, times, _, piece, length, doc in self.runs:
            sums = np.bincount(piece, np.repeat(values[place], times), len(length)).astype(np.int64)
            yield from zip(doc, sums, length, strict=True)


def blocks(batches, text_at: int, facts, size: int) -> Iterator[tuple[int, Block, list]]:
    """(number, block, batches whose documents are over): a partition's documents in order, cut after `size` bytes.

    facts gives for a text whatever the caller wants to know and whether the model learns from it.
    A finished batch is (number of documents up to its end, batch, facts of its documents).
    """
    first = TaskContext.get().partitionId() << BLOCK_BITS
    release()
    block, done, i, number = Block(), [], 0, 0
    for b in batches:
        known = []
        for text in b.column(text_at).to_pylist():
            data = (text or "").encode("utf-8", "surrogatepass")
            fact, learn = facts(text, data)
            known.append(fact)
            for codes in grams(data):
                block.add(number, codes, learn)
                if block.size >= size:
                    yield first | i, block, done
                    block, done, i = Block(), [], i + 1
            number += 1
        done.append((number, b, known))
    yield first | i, block, done
    release()


def _rows(batches, *names):
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in names), strict=True)


def _kept(file, rows):
    """The rows, whose names and n-grams go to the file."""
    for r in rows:
        file.write(struct.pack("<QI", r[1], len(r[2])) + r[2])
        yield r


def _lists(file) -> Iterator[tuple[int, bytes]]:
    while head := file.read(12):
        block, size = struct.unpack("<QI", head)
        yield block, file.read(size)


def _merge(rows) -> tuple[np.ndarray, np.ndarray]:
    """Sums of a shard's lists, of the n-grams to learn from, each for the other half. Holds the shard's n-grams and PENDING more."""
    codes, ns, held = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    for _, _, grams_, n in rows:
        code, m = np.cumsum(unpacked(grams_), dtype=U), unpacked(n).astype(np.int64)
        codes.append(code[m > 0] ^ HALF)
        ns.append(m[m > 0])
        held += len(codes[-1])
        if held > PENDING:
            one = total_by_code(np.concatenate(codes), np.concatenate(ns))
            codes, ns, held = [one[0]], [one[1]], 0
    return total_by_code(np.concatenate(codes), np.concatenate(ns))


def _levels(code: np.ndarray, n: np.ndarray) -> dict:
    counts = {ORDER: (code, n)}
    for k in range(ORDER - 1, LOCAL - 1, -1):
        counts[k] = extensions(counts[k + 1][0], k)
    return counts


def _counts_of_counts(code: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    for half, own in halves(code):
        yield half, np.bincount(np.minimum(n[own], 5), minlength=6)[1:5].tolist()


def shards_for(size: int) -> int:
    """Shards of a corpus of so many bytes: the square root of its MB, 16 at least, as blocks times shards are rows.

    There are 65,536 contexts of two bytes, so that many shards are the most; 4e15 bytes come to that. What a
    shard holds are distinct n-grams, which become fewer per byte as the corpus grows.
    """
    return 1 << min(16, max(4, math.ceil(math.log2(max(1.0, size / 1e6)) / 2)))


def fit(docs: DataFrame, facts, scratch: Scratch, size: int = BLOCK) -> tuple[str, int]:
    """Counts, model and answers for docs (text, and more). Returns the folder (model/<shard>, answers/<task>) and the number of shards."""
    spark = docs.sparkSession
    folder = new_folder(spark, "ngrams")
    scratch.paths.append(folder)
    text_at = docs.columns.index("text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = shards_for(int(total))

    def send(batches):
        for name, block, _ in blocks(batches, text_at, facts, size):
            if block.size:
                block.distinct(shards)
                rows = list(block.lists())
                for k in range(0, len(rows), 256):
                    s, g, n = zip(*rows[k : k + 256], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(s, pa.int32()), pa.array([name] * len(s), pa.int64()), pa.array(g, pa.binary()), pa.array(n, pa.binary())],
                        names=["shard", "block", "grams", "n"],
                    )

    dealt = docs.mapInArrow(send, SENT).repartitionById(shards, "shard").sortWithinPartitions("shard")

    def summary(batches):
        for shard, rows in groupby(_rows(batches, "shard", "block", "grams", "n"), itemgetter(0)):
            with atomic_output(f"{folder}/lists/{shard}") as f:
                code, n = _merge(_kept(f, rows))
            with atomic_output(f"{folder}/counts/{shard}") as f:
                f.write(_npz({"code": code, "n": n}))
            counts, out = _levels(code, n), [(0, 0, shard, 1)]
            for k, (c, m) in counts.items():
                out += [(k, half, i, x) for half, four in _counts_of_counts(c, m) for i, x in enumerate(four) if x]
            c, m = extensions(counts[LOCAL][0], 2)
            out += zip([2] * len(c), (c >> U(63)).tolist(), (c & ~HALF).tolist(), m.tolist(), strict=True)
            cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=["k", "half", "key", "x"])

    few = dealt.mapInArrow(summary, "k long, half long, key long, x long").groupBy("k", "half", "key").agg(F.sum("x")).collect()
    present = sorted(key for k, _, key, _ in few if k == 0)
    of_counts: dict = {}
    for k, half, i, x in few:
        if k > 2:
            of_counts.setdefault((k, half), np.zeros(4, np.int64))[i] = x
    two = sorted(((half << 63) | key, x) for k, half, key, x in few if k == 2)
    low = {2: (np.array([c for c, _ in two], U), np.array([x for _, x in two], np.int64))}
    low[1] = extensions(low[2][0], 1)
    for k, (c, m) in low.items():
        of_counts |= {(k, half): np.array(four) for half, four in _counts_of_counts(c, m)}
    discount = {key: discounts(c) for key, c in of_counts.items()}
    lower = estimate(low, discount, None)
    known = spark.sparkContext.broadcast((discount, lower))

    def answer(batches):
        discount, lower = known.value
        for shard in (present[i] for b in batches for i in b.column(0).to_pylist()):
            z = _read_npz(f"{folder}/counts/{shard}")
            model = Model(lower | estimate(_levels(z["code"], z["n"]), discount, lower[2][:2]))
            model.save(f"{folder}/model/{shard}")
            with open_read(f"{folder}/lists/{shard}") as f:
                for block, grams_ in _lists(f):
                    code = np.cumsum(unpacked(grams_), dtype=U)
                    values = np.rint(np.clip(model.log_probability(code) * np.float32(-STEPS), 0, 65535))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([shard], pa.int32()), pa.array([packed_values(values)], pa.binary()), pa.array([_check(code)], pa.int64())],
                        names=["block", "shard", "values", "code"],
                    )

    def keep(batches):
        rows = _rows(batches, "block", "shard", "values", "code")
        for task, own in groupby(rows, lambda r: r[0] >> BLOCK_BITS):
            with atomic_output(f"{folder}/answers/{task}") as f:
                for _, some in groupby(own, itemgetter(0)):
                    got = list(some)
                    f.write(len(got).to_bytes(8, "little") + sum(r[3] for r in got).to_bytes(16, "little", signed=True))
                    for r in got:
                        f.write(len(r[2]).to_bytes(8, "little") + r[2])
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["n"])

    each = spark.range(0, len(present), 1, max(1, len(present)))
    answers = each.mapInArrow(answer, "block long, shard int, values binary, code long").withColumn("task", F.shiftright("block", BLOCK_BITS))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    answers.repartition(parts, "task").drop("task").sortWithinPartitions("block", "shard").mapInArrow(keep, "n long").agg(F.sum("n")).collect()
    return folder, shards


def _check(code: np.ndarray) -> int:
    """A number that tells one list of n-grams from another, and that adds up over a block's shards."""
    return int(np.bitwise_xor.reduce(mixed(code)) >> U(2)) if len(code) else 0


def scored(batches, folder: str, shards: int, text_at: int, facts, size: int = BLOCK):
    """(batch, facts, log perplexities) for each Arrow batch of documents that `fit` has read in the same order.

    Log perplexity is the mean of -log P over a text's bytes, None for an empty one.
    """
    totals: dict[int, list] = {}
    file = None
    for name, block, done in blocks(batches, text_at, facts, size):
        if block.size:
            block.distinct(shards)
            file = file or open_read(f"{folder}/answers/{name >> BLOCK_BITS}")
            lists, check = int.from_bytes(file.read(8), "little"), int.from_bytes(file.read(16), "little", signed=True)
            values = np.concatenate([unpacked_values(file.read(int.from_bytes(file.read(8), "little"))) for _ in range(lists)] or [np.zeros(0, np.uint16)])
            _, first = np.unique(block.shard, return_index=True)
            if len(values) != len(block.sent) or check != sum(map(_check, np.split(block.sent, first[1:]))):
                raise RuntimeError(f"block {name} was read in another order than when it was counted")
            for doc, total, n in block.scores(values):
                t = totals.setdefault(doc, [0, 0])
                t[0] += int(total)
                t[1] += int(n)
        for end, b, known in done:
            own = [totals.pop(i, None) for i in range(end - b.num_rows, end)]
            yield b, known, [t[0] / STEPS / t[1] if t else None for t in own]
    if file:
        file.close()
