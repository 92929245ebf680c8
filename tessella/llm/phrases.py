"""Phrase collocations: weighted n-gram counts per language, scored at their weakest cut.

1. Texts are cut into pieces at punctuation and line ends. Identical pieces of a language become one row with
   a multiplicity, so a passage that a third of all documents share is counted once.
2. Tasks number the words of a block of pieces, count the block's distinct phrases, and send them as sorted,
   compressed lists to buckets; a bucket is a hash of language and phrase.
3. A bucket's lists are a stream that duckdb groups under a memory limit; what doesn't fit goes to disk, where Spark
   spills too. A bucket's counts are complete, so phrases below the least count end there.
4. Both parts of a phrase are at least as frequent as the phrase, so their counts are among those left. Each
   cut of each candidate sends requests for its parts to where these counts are (a shuffled join), and the
   answers meet again by phrase.

The empty phrase stands for all of a language's words: its count is n.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, prepare, release, table, written

SPLIT = r"[.,;:!?\x0A-\x0D]"
#: Bytes of pieces in a block; bytes of text for each bucket, and the most buckets (beyond, they grow on disk, not in memory).
BLOCK, BUCKET, MOST_BUCKETS = 7_000_000, 8_000_000, 50_000
#: What duckdb holds of a bucket in memory.
MEMORY = "256MB"
LISTS = "bucket int, lang string, phrases binary, counts binary"
SALTS = 64

U = np.uint64


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (its words, a blank between two), n: distinct pieces with words, and how often each occurs."""

    def cut(batches):
        for b in batches:
            text = pc.ascii_lower(pc.fill_null(b.column(1), ""))
            parts = pc.split_pattern_regex(text, SPLIT)
            lang = pc.fill_null(b.column(0), "und").take(pc.list_parent_indices(parts))
            piece = pc.ascii_trim(pc.replace_substring_regex(pc.list_flatten(parts), r"[\x20\x09]+", " "), " ")
            t = pa.table({"lang": lang, "piece": piece}).filter(pc.not_equal(piece, ""))
            t = t.group_by(["lang", "piece"]).aggregate([([], "count_all")]).rename_columns(["lang", "piece", "n"])
            yield from t.to_batches()

    each = docs.select("lang", "text").mapInArrow(cut, "lang string, piece string, n long")
    return each.groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _numbered(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's place among the distinct ones, these, and the sums of their numbers (below 2**53, so exact)."""
    place, distinct = pd.factorize(key)
    return place, distinct, np.bincount(place, n, len(distinct)).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
        return x ^ (x >> U(29))


def lists(lang: pa.Array, piece: pa.Array, n: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[int, str, bytes, bytes]]:
    """A block's phrases of up to `longest` words and their counts: (bucket, lang, phrases, counts), both compressed."""
    split = pc.split_pattern(piece, " ")
    length = pc.list_value_length(split).to_numpy()
    words = pc.list_flatten(split).dictionary_encode()
    # words in byte order, so that their places sort as they do
    rank = pc.sort_indices(words.dictionary).to_numpy()
    vocabulary = words.dictionary.take(pa.array(rank))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    word = place[words.indices.to_numpy()]
    langs = lang.dictionary_encode()
    names = langs.dictionary
    hashed = pd.util.hash_array(np.array(vocabulary.to_pylist() or [""], object))
    lang_hash = pd.util.hash_array(np.array(names.to_pylist(), object))
    ended = pc.binary_join_element_wise(vocabulary, "\n", "")

    spoken, weight, owner = np.repeat(langs.indices.to_numpy().astype(np.int64), length), np.repeat(n, length), np.repeat(np.arange(len(length)), length)
    width = max(1, len(vocabulary))
    at, distinct, total = _numbered(spoken * width + word, weight)
    first_lang, columns = distinct // width, [distinct % width]
    # the empty phrase: all words of a language
    of_lang = np.bincount(spoken, weight, len(names)).astype(np.int64)
    yield from _sent(names, np.flatnonzero(of_lang), lang_hash[np.flatnonzero(of_lang)], [], of_lang[of_lang > 0], None, None, buckets)
    unit_lang, unit_word = first_lang, columns[0]
    h = _mixed(lang_hash[first_lang] ^ hashed[columns[0]])
    yield from _sent(names, first_lang, h, columns, total, vocabulary, ended, buckets)
    # positions whose phrase of k words ends inside the piece, and that phrase's place
    start, unit = np.arange(len(word)), at
    for k in range(2, longest + 1):
        start, at = start[:-1], at[:-1]
        inside = (start + k - 1 < len(word)) & (owner[np.minimum(start + k - 1, len(word) - 1)] == owner[start]) if len(start) else np.zeros(0, bool)
        start, at = start[inside], at[inside]
        if not len(start):
            return
        at, distinct, total = _numbered(at * np.int64(len(unit_lang)) + unit[start + k - 1], weight[start])
        shorter, last = distinct // len(unit_lang), unit_word[distinct % len(unit_lang)]
        columns, first_lang = [c[shorter] for c in columns] + [last], first_lang[shorter]
        with np.errstate(over="ignore"):
            h = _mixed(h[shorter] * U(0x9E3779B97F4A7C15) + hashed[last])
        yield from _sent(names, first_lang, h, columns, total, vocabulary, ended, buckets)
        start, at = np.append(start, 0), np.append(at, 0)  # the loop cuts the last one off


def _sent(names, lang, h, columns, total, vocabulary, ended, buckets) -> Iterator[tuple[int, str, bytes, bytes]]:
    bucket = (h % U(buckets)).astype(np.int64)
    # np.lexsort takes the most important key last
    order = np.lexsort([*reversed(columns), lang, bucket])
    if columns:
        parts = [(ended if i == len(columns) - 1 else vocabulary).take(pa.array(c[order])) for i, c in enumerate(columns)]
        text = pc.binary_join_element_wise(*parts, " ") if len(parts) > 1 else parts[0]
    else:
        text = pa.array(["\n"] * len(order), pa.string())
    offsets, data = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1], text.buffers()[2]
    group = bucket[order] * len(names) + lang[order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    for i, j in zip(first, np.append(first[1:], len(group)), strict=True):
        sums = total[order[i:j]].astype("<i8").tobytes()
        yield int(bucket[order[i]]), names[int(lang[order[i]])].as_py(), _packed(bytes(data[offsets[i] : offsets[j]])), _packed(sums)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def block_lists(batches, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces to rows of LISTS."""
    kinds = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
    release()

    def out(held):
        t = pa.Table.from_batches(held).combine_chunks()
        rows = lists(t.column(0).combine_chunks(), t.column(1).combine_chunks(), t.column(2).to_numpy(), longest, buckets)
        for _, some in groupby(enumerate(rows), lambda x: x[0] // 256):
            columns = zip(*(r for _, r in some), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "lang", "phrases", "counts"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= BLOCK:
            yield from out(held)
            held, size = [], 0
    if held:
        yield from out(held)
    release()


def grouped(batches, least: int) -> Iterator[pa.RecordBatch]:
    """Lists of a bucket to lang, phrase, n: duckdb's sums of at least `least`, and of empty phrases whatever they are."""
    import duckdb

    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def unpacked():
        for b in batches:
            for lang, phrases, counts in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                text = pc.split_pattern(pa.array([_unpacked(phrases)], pa.binary()).cast(pa.string()), "\n").flatten()
                n = np.frombuffer(_unpacked(counts), "<i8")
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), text[: len(n)], pa.array(n)], schema=schema)

    release()
    near = next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.access(d, os.W_OK)), None)
    with tempfile.TemporaryDirectory(prefix="phrases-", dir=near) as spill:
        db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False})
        stream = pa.RecordBatchReader.from_batches(schema, unpacked())  # noqa: F841  duckdb finds it by its name
        sums = db.execute(f"SELECT lang, phrase, sum(n)::BIGINT AS n FROM stream GROUP BY lang, phrase HAVING sum(n) >= {least} OR phrase = ''")
        yield from sums.to_arrow_reader(10_000)
        db.close()
    release()


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10) -> DataFrame:
    """lang, phrase, n for phrases of up to `longest` words that occur `least` times, and the empty phrase with all words of the language.

    docs: lang (null: und) and text (null: empty); other columns are ignored, repeated rows count each. A text
    without words, and an empty table, give nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(MOST_BUCKETS, max(1, -(-int(size) // BUCKET)))
    sent = pieces(docs).mapInArrow(lambda batches: block_lists(batches, longest, buckets), LISTS)
    return sent.repartitionById(buckets, "bucket").mapInArrow(lambda batches: grouped(batches, least), "lang string, phrase string, n long")


def collocations(counts: DataFrame, longest: int = 3, cover: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of candidates of 2 to `longest` words, the best `top` of each language (None: all).

    counts: as phrase_counts gives them. A candidate's score is 1000000 * a * a / (l * r), rounded down, at the cut where
    this is least, ties to the first cut; decimals of 38 digits hold the products. Candidates inside a longer one that
    has `cover` percent of their occurrences are left out. Ranks go by score, a, and the phrase's bytes.
    """
    words = F.split("phrase", " ")
    cands = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    cut = F.sequence(F.lit(1), F.size("words") - 1)
    joined = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    asked = F.transform(cut, lambda k: F.array(
        F.struct(k.alias("k"), F.lit(True).alias("left"), joined(F.lit(1), k).alias("part")),
        F.struct(k.alias("k"), F.lit(False).alias("left"), joined(k + 1, F.size("words") - k).alias("part")),
    ))
    requests = cands.select("lang", "phrase", "a", F.inline(F.flatten(asked)))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("found")), ["lang", "part"])
    cuts = answers.groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("found"))).alias("l"), F.max(F.when(~F.col("left"), F.col("found"))).alias("r"))
    exact = {c: F.col(c).cast("decimal(20,0)") for c in "alr"}
    cuts = cuts.withColumns({f"_{c}": v for c, v in exact.items()}).withColumn("score", F.expr("(1000000 * _a * _a) div (_l * _r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    # what each longer candidate holds
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.size("words") - m + 1), lambda s: joined(s, m))))
    longer = cands.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    held = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    rows = left.select("lang", "phrase", "a", "best.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # first within parts of a language, so that no task ranks all of one
        salt = F.pmod(F.hash("phrase"), F.lit(SALTS))
        rows = rows.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        rows = rows.where(F.col("rank") <= top)
    n = counts.where("phrase = ''").select("lang", "n")
    return rows.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language of all documents."""
    scratch = Scratch(spark, "phrases")
    counts = scratch.write(phrase_counts(table(spark, sf_dir, "documents")), "counts")
    out = written(collocations(counts), "collocations")
    scratch.drop()
    return out


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM d),
g AS (
  SELECT lang, unnest(list_transform(range(1, len(words) + 1), lambda i: words[i])) AS phrase, 1 AS m FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])), 2 FROM w
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])), 3 FROM w),
f AS (SELECT lang, phrase, m, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS s FROM f WHERE m > 1 AND n >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.m, a, k.k, p.n AS l, q.n AS r, (1000000::HUGEINT * a * a) // (p.n::HUGEINT * q.n) AS score
  FROM k JOIN f p ON p.lang = k.lang AND p.phrase = array_to_string(s[1:k.k], ' ') JOIN f q ON q.lang = k.lang AND q.phrase = array_to_string(s[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
h AS (SELECT lang, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase, a FROM c WHERE m = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM h GROUP BY ALL),
z AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE coalesce(100 * longer < 50 * a, true))
SELECT z.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM z JOIN t ON t.lang = z.lang WHERE rank <= 2000
"""
