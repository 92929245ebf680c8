"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again as the
next one's docs. All but the last return the columns of documents, and any other columns of docs
unchanged, whatever their names. Every stage works on all rows that its predecessor kept, and an
empty table stays empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import langid, mixing, neardup, packing, perplexity
from tessella.llm.common import Scratch, join_checked, new_folder, remove, table

#: Rows (of a long each) up to which a list of rejected documents is broadcast.
LISTED = 500_000
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def plain(docs: DataFrame) -> DataFrame:
    """docs, with names for other columns that no operator uses."""
    return docs.toDF(*[c if c in DOCUMENT else f"_other{i}" for i, c in enumerate(docs.columns)])


def named(rows: DataFrame, safe: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of safe = plain(docs) in rows, under their names in docs."""
    return rows.select(*[F.col(a).alias(b) for a, b in zip(safe.columns, docs.columns, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language and ambiguous ones; lang becomes the predicted language.

    Null, empty and letterless texts have no language. Repeated rows are answered alike; a null
    doc_id or lang rejects nothing.
    """
    safe = plain(docs)
    model = langid.fit(safe.where(langid.learnable(F.col("doc_id"))).select("text", "lang"))
    got = langid.predict(safe, model).where((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("lang_ambiguous"))
    return named(got.withColumn("lang", F.col("lang_pred")), safe, docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that fail the rules on structure or lie outside their language's perplexity band.

    Null and short texts fail. Repeated rows are judged alike; a null language is one of its own.
    """
    safe, models = plain(docs), Scratch(spark, "quality-stage")
    measured = Scratch(spark, "quality-stage").write(perplexity.measure(safe, models), "measured")
    models.drop()
    return named(perplexity.judge(measured, perplexity.bands(measured)).where("kept"), safe, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, a likeness of 0.8 or more.

    Of rows that repeat a doc_id the least stays (by text, lang, source, n_chars, then the others as
    JSON). Rows with a null doc_id and documents without a word are in no group, so all of them stay,
    the latter once for each doc_id.
    """
    safe, scratch = plain(docs), Scratch(spark, "dedup-stage")
    got = neardup.near_duplicates(safe, k=5, num=80)
    gone = scratch.write(got.where("not kept").select("doc_id").distinct(), "gone")
    rest = join_checked(safe, gone, "doc_id", "left_anti", LISTED)
    again = scratch.write(
        got.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again"
    )
    if not again.limit(1).count():
        return named(rest, safe, docs)
    once = join_checked(rest, again, "doc_id", "left_anti", LISTED)
    others = [c for c in safe.columns if c != "doc_id"]
    order = F.struct("text", "lang", "source", "n_chars", F.to_json(F.struct(*others)))
    several = join_checked(rest, again, "doc_id", "left_semi", LISTED).groupBy("doc_id").agg(F.min_by(F.struct(*others), order).alias("_row"))
    return named(once.select(*safe.columns).unionByName(several.select("doc_id", "_row.*")), safe, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's target rate, in random order.

    Rows that repeat a doc_id draw alike; a null doc_id draws as the word null; a null source is a
    source; null and empty texts are documents of size 1.
    """
    safe = plain(docs)
    return named(mixing.replicate(safe), safe, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024, by power-of-two pieces; a row per piece.

    Null text is empty: its end token is a sequence. Repeated rows are packed once each. Other
    columns of docs end here.
    """
    import public_tokenizers

    return packing.digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 1024))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The language and perplexity models have no SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        last, path = path, new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
    return STAGES[-1][1](spark, docs, sf_dir)
