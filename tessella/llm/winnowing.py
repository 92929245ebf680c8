"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, K consecutive words make a gram hash (by doubling: pairs, then pairs of pairs),
and of every WINDOW consecutive grams the least is chosen, the rightmost among equals. A gram is one
long: 36 bits of hash above 27 bits that fall as the position grows, so a plain minimum finds the
least hash and breaks ties to the right, and the position stays with the hash. Minima over windows
come by doubling too, so a window costs log2(WINDOW) steps per gram and not WINDOW.

Whatever two texts share in a run of K + WINDOW - 1 words leaves a common fingerprint; a shared run
of fewer than K words leaves none. Words are runs of ASCII letters, digits and all signs above ASCII;
in scripts without blanks between words (Han, Kana, Thai and the like) every sign is a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import Scratch, table

K, WINDOW = 4, 16
POSITION_BITS = 27
LAST = (1 << POSITION_BITS) - 1
#: Signs of scripts that are written without blanks: each is a word by itself.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"
#: Anything but ASCII letters and digits and what lies above ASCII separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Ranges of the identifier order in which neighbours are found, beside one per so many rows.
RANGES, RANGE_ROWS = 256, 1_000_000


def _pairs(name: str, gap: int, join) -> Column:
    """Each element joined with the one `gap` after it; past the end there's null."""
    c = F.col(name)
    return F.zip_with(c, F.slice(c, gap + 1, F.greatest(F.size(c), F.lit(1))), join)


def winnow(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds column `out`: the chosen grams in order, each `hash << 27 | (LAST - position)`.

    Null and wordless texts have none; a text of fewer than K words has one, of all its words.
    """
    w, n = f"_{out}_w", f"_{out}_n"
    t = F.coalesce(F.col(text), F.lit(""))
    t = F.when(t.rlike(UNSPACED), F.regexp_replace(t, f"({UNSPACED})", " $1 ")).otherwise(t)
    words = F.array_remove(F.split(F.lower(t), SEPARATORS), "")
    df = df.withColumn(w, F.transform(words, lambda x: F.xxhash64(x))).withColumn(n, F.size(w))
    gap = 1
    while gap < K:
        df = df.withColumn(w, _pairs(w, gap, lambda a, b: F.xxhash64(a, b)))
        gap *= 2
    # grams: those with all K words, or one; an empty array stays empty
    df = df.withColumn(w, F.slice(w, 1, F.greatest(F.col(n) - (K - 1), F.lit(1))))
    pack = F.transform(
        w, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 64 - 36), POSITION_BITS).bitwiseOR(F.lit(LAST) - i.cast("long"))
    )
    df = df.withColumn(w, pack).withColumn(n, F.size(w))
    gap = 1
    while gap < WINDOW:
        df = df.withColumn(w, _pairs(w, gap, lambda a, b: F.least(a, b)))
        gap *= 2
    full = F.slice(w, 1, F.greatest(F.col(n) - (WINDOW - 1), F.lit(1)))
    return df.withColumn(out, F.array_distinct(full)).drop(w, n)


def hashes(chosen: Column) -> Column:
    """The distinct hashes of chosen grams."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def positions(chosen: Column) -> Column:
    """The chosen grams' positions, in words from 0."""
    return F.transform(chosen, lambda x: F.lit(LAST) - x.bitwiseAND(F.lit(LAST)))


def digest(chosen: Column) -> Column:
    """One string for hashes and positions; equal texts have equal ones."""
    return F.md5(F.concat_ws(",", F.transform(chosen, lambda x: x.cast("string"))))


def likeness(a: Column, b: Column, common: Column) -> Column:
    """Common hashes over all hashes of two sets; 1 for two empty sets."""
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def fingerprint(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) and: grams (chosen), hashes, positions. Columns of these names are replaced."""
    df = winnow(docs.drop("grams", "hashes", "positions"), "text", "grams")
    return df.withColumn("hashes", hashes(F.col("grams"))).withColumn("positions", positions(F.col("grams")))


def followers(keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Who follows whom in descending doc_id: doc_id, k (the follower's), prev_id, prev_k, prev_n.

    keys: distinct (doc_id, k) with n. Nulls come last and ties by k; the first follows the last.
    Neighbours are found within ranges of the order, and only a row per range meets the others.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.col("k")]
    parts = max(RANGES, keys.count() // RANGE_ROWS)
    ranged = scratch.write(keys.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    w = Window.partitionBy("part").orderBy(*order)
    row = F.struct("doc_id", "k")
    seen = ranged.withColumns({"next": F.lead(row).over(w), "at": F.row_number().over(w)})
    heads = seen.where("at = 1").select("part", row.alias("head"))
    ends = Window.orderBy("part")
    turn = heads.select(
        "part", F.coalesce(F.lead("head").over(ends), F.first("head").over(ends)).alias("after")
    )  # a row per range
    return (
        seen.join(turn, "part")
        .withColumn("next", F.coalesce("next", "after"))
        .select("next.doc_id", "next.k", F.col("doc_id").alias("prev_id"), F.col("k").alias("prev_k"), F.col("n").alias("prev_n"))
    )


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how near they and the next document's are.

    docs: doc_id, text; other columns are ignored. The next document is by descending doc_id (nulls
    last, texts of one doc_id by their hashes; the first follows the last); rows that repeat both
    doc_id and text get equal answers, and a row each. Null text is empty. An empty table stays empty.
    Each text is shuffled once whole, by its key, and once as far as its predecessor needs it.
    """
    scratch = Scratch(docs.sparkSession, "winnowing")
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    keys = scratch.write(
        base.select("doc_id", "k", F.char_length("text").alias("n")).groupBy("doc_id", "k").agg(F.first("n").alias("n"), F.count("*").alias("rows")),
        "keys",
    )
    prev = scratch.write(followers(keys.drop("rows"), scratch), "prev")
    own = winnow(base, "text", "grams").select(
        "doc_id", "k", "text", "grams"
    )  # both joins read just these columns, so that they share one shuffle of the texts
    p = prev.toDF("f_id", "f_k", "prev_id", "prev_k", "prev_n")
    nexts = own.join(p, own["doc_id"].eqNullSafe(p["f_id"]) & (own["k"] == p["f_k"])).select(
        "prev_id",
        "prev_k",
        F.col("text").substr(F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("head"),
        F.col("grams").alias("next_grams"),
    )
    if keys.where("rows > 1").limit(1).count():
        nexts = nexts.dropDuplicates(["prev_id", "prev_k"])
    n = F.char_length("text")
    both = own.join(nexts, own["doc_id"].eqNullSafe(nexts["prev_id"]) & (own["k"] == nexts["prev_k"])).select(
        "doc_id",
        n.alias("n_chars"),
        F.concat(F.col("text").substr(F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("head")).alias("edited"),
        "grams",
        "next_grams",
    )
    both = winnow(both, "edited", "edited_grams").withColumns(
        {"hashes": hashes(F.col("grams")), "edited_hashes": hashes(F.col("edited_grams")), "next_hashes": hashes(F.col("next_grams"))}
    )
    a, b, c = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    both = both.withColumns({"_edited": F.size(F.array_intersect(a, b)), "_next": F.size(F.array_intersect(a, c))})
    return both.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("grams")).alias("fingerprint"),
        digest(F.col("edited_grams")).alias("edited_fingerprint"),
        likeness(a, b, F.col("_edited")).alias("near_edited"),
        likeness(a, c, F.col("_next")).alias("near_next"),
        F.size("hashes").cast("long").alias("n_hashes"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against their edited texts and their next documents."""
    return compare_edits(table(spark, sf_dir, "documents"))
