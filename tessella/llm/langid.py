"""Language identification by error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier separates the languages
with +1 from those with -1 by the log odds of hashed byte trigrams, learned from counts that Spark
gathers over all labelled rows. A text's margins are compared with every codeword under an
exponential loss weighted by the bits' reliability; the nearest codeword is the prediction, and the
gap to the second gives the score. A prediction with a small gap is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm.common import prepare, table

BUCKETS = 1 << 13
#: Longest code word drawn at random, for more languages than an exhaustive code serves.
RANDOM_BITS = 48
EXHAUSTIVE = 5
AMBIGUOUS = 0.05
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: ASCII but letters counts as a blank, capitals as small letters; bytes above stay.
FOLD = bytes(ord(chr(b).lower()) if chr(b).isalpha() and b < 128 else b if b > 127 else 32 for b in range(256))
#: Texts are counted in chunks of this size, so a very long text needs little memory.
CHUNK = 1 << 18


def trigrams(text: str) -> np.ndarray:
    """Counts of the text's byte trigrams, hashed into BUCKETS."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").translate(FOLD) + b" ", np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, max(1, len(data) - 2), CHUNK):
        b = data[at : at + CHUNK + 2].astype(np.uint32)
        h = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        h = h[h != 0x202020]
        out += np.bincount((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13), minlength=BUCKETS)
    return out


def codewords(k: int, seed: int = 1) -> np.ndarray:
    """k rows of +1 and -1: the exhaustive code for a few languages, else the best of random ones."""
    if k < 2:
        return np.ones((k, 1), np.int8)
    if k <= EXHAUSTIVE:
        cols = [c for c in itertools.product((1, -1), repeat=k) if c[0] == 1 and -1 in c]
        return np.array(cols, np.int8).T
    rng, best, most = np.random.default_rng(seed), None, -1
    bits = max(RANDOM_BITS, 4 * int(np.ceil(np.log2(k))))
    for _ in range(100):
        code = rng.choice(np.array([1, -1], np.int8), (k, bits))
        if (np.abs(code.sum(0, dtype=np.int64)) == k).any():
            continue
        agree = code.astype(np.int64) @ code.T
        gap = (bits - agree[~np.eye(k, dtype=bool)].max()) // 2
        if gap > most:
            best, most = code, gap
    return best


def counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of docs (text, lang); rows without either are left out."""
    prepare(docs.sparkSession)

    def count(batches):
        # dense arrays per language and partition, so each sends a bounded number of rows
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += trigrams(text)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"]
            )

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """langs, their codewords, and a weight vector, centre and reliability for each bit."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(x for x, n in by_lang.items() if n.sum())
        if not self.langs:
            return
        p = np.stack([(by_lang[x] + 0.5) / (by_lang[x].sum() + 0.5 * BUCKETS) for x in self.langs])
        self.code = codewords(len(self.langs))
        if len(self.langs) == 1:
            return
        weights, centre, scale, reliable = [], [], [], []
        for bit in self.code.T:
            w = np.log(p[bit == 1].mean(0)) - np.log(p[bit == -1].mean(0))
            expected = p @ w
            up, down = expected[bit == 1].mean(), expected[bit == -1].mean()
            weights.append(w)
            centre.append((up + down) / 2)
            scale.append(max((up - down) / 2, 1e-9))
            reliable.append(np.clip((bit * (expected - centre[-1]) / scale[-1]).min(), 0.05, 1.0))
        self.weights = np.array(weights, np.float32).T / np.array(scale, np.float32)
        self.centre = np.array(centre) / np.array(scale)
        self.reliable = np.array(reliable) / np.sum(reliable)

    def decode(self, n: np.ndarray) -> tuple[str, float, bool]:
        """Nearest language, score from 0 to 1, and whether it is ambiguous. n: a text's trigram counts."""
        if not self.langs or not n.sum():
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        margin = n.astype(np.float32) @ self.weights / n.sum() - self.centre
        loss = np.exp(-np.clip(self.code * margin, -20, 20)) @ self.reliable
        first, second = np.argsort(loss, kind="stable")[:2]
        score = float(1 - loss[first] / loss[second])
        return self.langs[first], min(1.0, max(0.0, score)), score < AMBIGUOUS


def learnable(doc_id: Column) -> Column:
    """Documents outside the fold that is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2


def fit(docs: DataFrame) -> Model:
    """The model of docs (text, lang). The driver gets BUCKETS rows a language, and so many numbers a language are what a
    task and a worker hold: 64 KB for each name that occurs in lang, some MB for the languages that there are."""
    by: dict[str, np.ndarray] = {}
    for r in counts(docs).toLocalIterator():
        by.setdefault(r.lang, np.zeros(BUCKETS, np.int64))[r.bucket] = r.n
    return Model(by)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns, then lang_pred, lang_score, lang_ambiguous.

    Only the column text is read. Null texts and texts without a letter are `und`, with score 0, and
    ambiguous. Repeated rows are answered alike; an empty table stays empty; columns of docs with
    the three added names are replaced.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.drop("lang_pred", "lang_score", "lang_ambiguous")

    def label(texts):
        m = sent.value
        for t in texts:
            yield m.decode(trigrams(t)) if t and LETTER.search(t) else (UNKNOWN, 0.0, True)

    at = base.columns.index("text")

    def run(batches):
        for b in batches:
            got = list(label(b.column(at).to_pylist()))
            cols = [pa.array([g[i] for g in got], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "lang_pred", "lang_score", "lang_ambiguous"])

    added = StructType().add("lang_pred", "string").add("lang_score", "double").add("lang_ambiguous", "boolean")
    schema = StructType(base.schema.fields + added.fields)
    return base.mapInArrow(run, schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; learned from those whose identifier isn't in the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(learnable(F.col("doc_id"))).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (~learnable(F.col("doc_id"))).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_ambiguous").alias("ambiguous"),
    )
