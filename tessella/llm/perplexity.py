"""Quality rules: structure of the text, and perplexity under an n-gram model of the corpus.

The models (ngrams.py) are modified Kneser-Ney models over n-grams of six bytes, counted by Spark
over all documents that pass the rules on structure, and held as sorted hash arrays in shards.
Documents are scored by what the other half of the documents has taught; those that fail the rules
are scored too, but what they are made of has not been learned.

A document is rejected when its log perplexity is above the upper or below the lower band of its
language. The bands lie around the median of the language's documents, at a multiple of the
deviation of their upper and of their lower half; the lower one is wider, as families of copies
make their own members likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.llm import ngrams
from tessella.llm.common import Scratch, join_checked, prepare, table

#: Width of a band on each side, in robust deviations of log perplexity, and at least.
ABOVE, BELOW, LEAST = 6.0, 12.0, 0.1
SYMBOL_CHARS = b"#*$%&|<>"
CAPITALS, SMALL = bytes(range(65, 91)), bytes(range(97, 123))
MIN_WORDS = 50
#: The model learns from texts with at most so many symbols a word, and so many capitals a letter (A to Z).
SYMBOLS_A_WORD, CAPITALS_A_LETTER = 0.1, 0.3
#: Bytes of text in a block of the query, which has a worker's memory for itself; the larger, the fewer n-grams are sent twice.
QUERY_BLOCK = 8_000_000
#: Different words of which three numbers make one of 63 bits.
THREE_FIT = 1 << 21
#: Languages whose bands are broadcast.
LANGUAGES = 10_000


def structure(text: str | None, data: bytes | None = None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text (data: its UTF-8); all 0 for null.

    Words are runs of anything but ASCII white space. A line repeats when it has a word and equals
    an earlier one. A word repeats when a window of three words that holds it occurs twice or more.
    """
    if data is None:
        data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text or "") - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(data) - len(data.translate(None, SYMBOL_CHARS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n >= 3:
        known = dict(zip(dict.fromkeys(words), range(n)))
        ids = np.fromiter(map(known.__getitem__, words), np.int64, n)
        pair = ids[:-2] * len(known) + ids[1:-1]
        if len(known) > THREE_FIT:
            _, pair = np.unique(pair, return_inverse=True)
        window = pair * len(known) + ids[2:]
        ordered = np.sort(window)  # without the places, which are asked for only where a window comes again
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            again = twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window
            covered = np.zeros(n, bool)
            for j in range(3):
                covered[j : n - 2 + j] |= again
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*METRICS, "base_failed", "log_perplexity"]


def facts(text: str | None, data: bytes) -> tuple[tuple, bool]:
    """(METRICS and base_failed, whether the model learns from the text)."""
    s = structure(text, data)
    failed = s[0] < MIN_WORDS or 100 * s[4] > 50 * s[0]
    if failed or s[2] > SYMBOLS_A_WORD * s[0]:
        return (*s, failed), False
    capitals = len(data) - len(data.translate(None, CAPITALS))
    letters = capitals + len(data) - len(data.translate(None, SMALL))
    return (*s, failed), capitals <= CAPITALS_A_LETTER * letters


def measure(docs: DataFrame, scratch: Scratch, block: int = ngrams.BLOCK) -> DataFrame:
    """docs' columns and MEASURES (columns of those names are replaced). Perplexity is null for empty texts.

    docs (text, and more) is read twice and must come in the same partitions and order, as a
    table does; that is checked. What is returned needs the tables in scratch.
    """
    prepare(docs.sparkSession)
    base = docs.drop(*MEASURES)
    folder, shards = ngrams.fit(base.select("text"), facts, scratch, block)
    text_at = base.columns.index("text")
    kinds = [pa.int64()] * 5 + [pa.bool_()]

    def run(batches):
        for b, known, logs in ngrams.scored(batches, folder, shards, text_at, facts, block):
            cols = [pa.array([k[i] for k in known], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols, pa.array(logs, pa.float64())], names=[*b.schema.names, *MEASURES])

    schema = StructType(list(base.schema.fields))
    for c in METRICS:
        schema.add(c, "long")
    return base.mapInArrow(run, schema.add("base_failed", "boolean").add("log_perplexity", "double"))


def bands(measured: DataFrame) -> DataFrame:
    """lang, lower, upper of log perplexity, from the documents that pass the rules on structure.

    A half's deviation is its quartile's distance from the median over 0.6745, so outliers don't
    widen it. Quartiles are of values rounded to 0.0001: their counts are few at any size, are
    combined before the shuffle, and don't depend on the order of partitions.
    """
    q = F.expr("percentile(round(log_perplexity, 4), array(0.25, 0.5, 0.75))")
    rows = measured.where("not base_failed and log_perplexity is not null").groupBy("lang").agg(q.alias("q"))
    half = lambda times, a, b: F.greatest(times * (F.col("q")[b] - F.col("q")[a]) / 0.6745, F.lit(LEAST))
    return rows.select("lang", (F.col("q")[1] - half(BELOW, 0, 1)).alias("lower"), (F.col("q")[1] + half(ABOVE, 1, 2)).alias("upper"))


def _key(lang: str) -> Column:
    return F.struct(F.col(lang).isNull(), F.coalesce(lang, F.lit("")))


def judge(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds lower, upper and kept. There is a row of limits per language; a null language is one too."""
    left = measured.drop("lower", "upper", "kept", "_lang").withColumn("_lang", _key("lang"))
    lim = limits.select(_key("lang").alias("_lang"), "lower", "upper")
    within = F.col("log_perplexity").between(F.col("lower"), F.col("upper"))
    joined = join_checked(left, lim, "_lang", "left", LANGUAGES).drop("_lang")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))


def quality(docs: DataFrame, block: int = ngrams.BLOCK) -> DataFrame:
    """docs' columns but the text, MEASURES, the language's band (lower, upper) and kept, per row of docs (text, lang, and more).

    The model and the bands come from all rows. Null and empty texts fail for want of words;
    repeated rows are judged alike; a null language has a band of its own; an empty
    table stays empty. Columns of the added names are replaced. docs should be a table (see measure).
    """
    scratch = Scratch(docs.sparkSession, "quality")
    keep = Scratch(docs.sparkSession, "quality")
    measured = keep.write(measure(docs, scratch, block).drop("text"), "measured")
    scratch.drop()
    return judge(measured, bands(measured))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by their own language column."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), QUERY_BLOCK).select(
        "doc_id", *METRICS, "base_failed", "kept", F.round("log_perplexity", 6).alias("log_perplexity")
    )
