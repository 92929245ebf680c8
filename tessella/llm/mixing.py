"""Mixing sources to target weights by Poisson replication.

A source's target repetition rate is its weight's share of the corpus over its own size. Each
document draws its number of copies from a Poisson distribution with that mean, by inverting the
distribution at a uniform number hashed from the seed and the document's identifier; copies are
exploded and the result is put in a random order by a hashed key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import small, table

#: A larger mean is drawn as a sum of this many's and a rest, so exp(-mean) never underflows.
CHUNK = 32.0
#: Sources up to which the rates are broadcast (a row of at most some 1 KB each).
BROADCAST_SOURCES = 20_000
SALTS = 64
#: Exponent of a source's size in its default weight: 1 keeps the corpus's shares, 0 levels them.
TEMPERATURE = 0.7


def uniform(*parts: Column) -> Column:
    """52 bits of the md5 of the parts, as a number in [0, 1)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cdf(mean: Column) -> Column:
    """P(X <= k) for k from 0, until the tail is beyond 12 standard deviations."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all"))

    def step(s, k):
        p = s["p"] * mean / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def rates(docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0) -> DataFrame:
    """source, size, rate. A document's size is its characters and one end mark.

    weights: (source, weight); a source it lacks gets no copies. Without it, weights are sizes to
    the power TEMPERATURE. epochs scales the size of the result against the corpus. A null source
    is a source like any other.
    """
    sizes = docs.groupBy("source").agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0)) + F.lit(1)).cast("double").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("size", F.lit(TEMPERATURE)))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.sum("weight").cast("double").alias("weight"))
        weighed = sizes.join(w, sizes["source"].eqNullSafe(w["_s"]), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    total = weighed.agg(F.sum("size").alias("_size"), F.sum("weight").alias("_weight"))
    share = F.when(F.col("_weight") > 0, F.col("weight") / F.col("_weight")).otherwise(F.lit(0.0))
    # one row of totals, so this join multiplies nothing
    return weighed.join(F.broadcast(total)).select("source", "size", (share * F.col("_size") * epochs / F.col("size")).alias("rate"))


def replicate(
    docs: DataFrame, weights: DataFrame | None = None, epochs: float = 1.0, seed: int = 1
) -> DataFrame:
    """docs' columns and n_copies, copy (from 1), rate, shuffle_key, in the order of shuffle_key.

    docs needs doc_id, text and source; other columns come along, save that the four added names
    replace columns of the same names. Documents that draw no copy are absent. Rows that repeat a
    doc_id draw the same count; a null doc_id draws as the word null; an empty table stays empty.
    """
    per_source = rates(docs, weights, epochs).select(
        F.col("source").alias("_source"),
        F.col("rate").alias("rate"),
        F.floor(F.col("rate") / CHUNK).cast("int").alias("_whole"),
        cdf(F.col("rate") - F.floor(F.col("rate") / CHUNK) * CHUNK).alias("_rest"),
    )
    base = docs.drop("n_copies", "copy", "rate", "shuffle_key")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if small(per_source.select("_source"), BROADCAST_SOURCES):
        joined = base.join(F.broadcast(per_source), same)
    else:
        # a source may hold a third of all rows: spread it over salts
        salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = base.withColumn("_row", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(
            salted, same & (F.col("_row") == F.col("_salt"))
        )
    ident = F.col("doc_id")

    def draws(table: Column, u: Column) -> Column:
        return F.size(F.filter(table, lambda c: c <= u))

    whole = F.aggregate(
        F.when(F.col("_whole") > 0, F.sequence(F.lit(1), F.col("_whole"))).otherwise(F.array().cast("array<int>")),
        F.lit(0),
        lambda s, j: s + draws(cdf(F.lit(CHUNK)), uniform(F.lit(seed), ident, j)),
    )
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("order"), F.lit(str(seed)), F.coalesce(ident.cast("string"), F.lit("null")), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return (
        joined.withColumn("_u", uniform(F.lit(seed), ident, F.lit(0)))
        .withColumn("n_copies", draws(F.col("_rest"), F.col("_u")) + whole)
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
        .withColumn("shuffle_key", key)
        .select(*base.columns, "n_copies", "copy", "rate", "shuffle_key")
        .orderBy("shuffle_key", "doc_id", "copy")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, default weights, one epoch."""
    got = replicate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return got.select(
        "doc_id", "source", F.col("copy").cast("long").alias("copy"), F.col("n_copies").cast("long").alias("n_copies"),
        F.round("rate", 6).alias("rate"), "shuffle_key", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
    )


#: For means below CHUNK, as the fixtures have them. {documents} stands for the table or a subquery.
MIX_CTES = """
sizes AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM {documents} GROUP BY source),
totals AS (SELECT sum(size) AS size, sum(pow(size, 0.7)) AS weight FROM sizes),
rates AS (SELECT source, pow(s.size, 0.7) / t.weight * t.size * 1.0 / s.size AS rate FROM sizes s, totals t),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, 'null') || ':0'), 1, 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM {documents} d),
counted AS (
  SELECT d.doc_id, d.text, d.source, any_value(r.rate) AS rate, count(*) FILTER (WHERE r.c <= d.u) AS n_copies
  FROM drawn d JOIN cdf r ON r.source IS NOT DISTINCT FROM d.source GROUP BY d.doc_id, d.text, d.source),
mixed AS (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM counted WHERE n_copies > 0)
"""

OP6_SQL = "WITH RECURSIVE " + MIX_CTES.format(documents="documents") + """
SELECT doc_id, source, copy, n_copies, round(rate, 6) AS rate,
  ('0x' || substr(md5('order:1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 15))::BIGINT AS shuffle_key,
  md5(coalesce(text, '')) AS text_md5
FROM mixed
"""
