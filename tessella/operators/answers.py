"""Retrieval and questions end to end: filters, vector scores by section, ordering, the shape of results, and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators import retrieval, vectors

#: Characters of a source's text, the answer without sources, documents' keywords in a listing, and the gate's limits.
SOURCE_CHARS, NOTHING, LISTED_KEYWORDS = 1200, "No relevant knowledge found.", 50
GATE_SOURCES, GATE_SCORE = 3, 0.8
FILTERS = "doc_name string, section string, page_start int, page_end int, regex string, chunk string"
RESULT = "struct<doc_id:bigint,section:string,section_id:string,parent_section_id:string,page:int,page_start:int,page_end:int,text:string,score:double>"


def empty_result(spark: SparkSession, query: str | None = None, **filters) -> DataFrame:
    """One row: query, filters, count 0, results []."""
    names = [f.split()[0] for f in FILTERS.split(", ")]
    if unknown := set(filters) - set(names):
        raise ValueError(f"no such filter: {sorted(unknown)}")
    row = [(query, tuple(filters.get(n) for n in names), 0, [])]
    return spark.createDataFrame(row, f"query string, filters struct<{FILTERS.replace(' ', ':').replace(',:', ',')}>, count long, results array<{RESULT}>")


def vector_scores(rows: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """rows (doc_id, section, section_id, parent_section_id, text, ...) of documents that have a hit, with score.

    hits: doc_id, section_id, score. A row has the larger of its section's and its parent's best score, 0.2
    if its text holds the whole query, and the score of its section path; rows without any keep 0.
    """
    best = hits.where("doc_id is not null and section_id <> ''").groupBy("doc_id", "section_id").agg(F.max("score").alias("s"))
    docs = best.select("doc_id").distinct()
    get = lambda df, on, name: df.join(best.select("doc_id", F.col("section_id").alias(on), F.col("s").alias(name)), ["doc_id", on], "left")
    got = rows.join(docs, "doc_id", "left_semi")
    for on, name in (("section_id", "_own"), ("parent_section_id", "_up"), ("section", "_path")):
        got = get(got, on, name)
    q = F.lit(query.strip())
    score = vectors.boosted_score(F.col("_own"), F.col("_up"), F.col("_path"), q, F.col("text")) if query.strip() else F.lit(0.0)
    return got.withColumn("score", score).select(*rows.columns, "score")


def retrieve(rows: DataFrame, query: str = "", hits: DataFrame | None = None, names: DataFrame | None = None, limit: int = 20, **filters) -> DataFrame:
    """One row: query, filters, count (before the limit), results (at most max(1, min(limit, 50)), the best first).

    rows: what `search_rows` gives. hits: nearest sections, for a search by vectors, which needs a query.
    names: (doc_id, name), for the filter doc_name. Rows of equal scores keep the order of document and page.
    """
    spark = rows.sparkSession
    shape = empty_result(spark, query, **filters)
    if hits is not None and not query.strip():
        return shape
    found = rows
    if filters.get("doc_name"):
        found = found.join(retrieval.best_tier(names, filters["doc_name"]).select("doc_id"), "doc_id", "left_semi")
    given = {k: v for k, v in filters.items() if k != "doc_name"}
    found = retrieval.search_filter(found, **given)
    found = vector_scores(found, hits, query) if hits is not None else found.withColumn("score", F.lit(0.0))
    fields = [f.split(":")[0] for f in RESULT[7:-1].split(",")]
    size = max(1, min(limit, retrieval.MOST_ROWS))
    top = retrieval.best(found, size, "doc_id", "page").agg(F.collect_list(F.struct((-F.col("score")).alias("o"), "doc_id", "page", F.struct(*fields).alias("r"))).alias("l"))
    got = top.select(F.transform(F.array_sort("l"), lambda x: x["r"]).cast(f"array<{RESULT}>").alias("results")).join(F.broadcast(found.agg(F.count("*").alias("count"))))
    return shape.select("query", "filters").join(F.broadcast(got)).select("query", "filters", "count", "results")


def gate(sources: DataFrame, least: int = GATE_SOURCES, above: float = GATE_SCORE) -> DataFrame:
    """One row: n, answer: the best source's text if there are enough sources and its score is above the threshold."""
    best = F.max_by("text", F.struct("score", -F.col("rank")))
    return sources.agg(F.count("*").alias("n"), F.when((F.count("*") >= least) & (F.max("score") > above), best).alias("answer"))


def ask(
    stored: DataFrame, query: list[float], question: str, top_k: int = 4, section: str = "section", rerank: Column | None = None, synthesize: Column | None = None
) -> DataFrame:
    """(rank, vec_id, score, text, answer) of one question over stored (vec_id, embedding, section, text).

    Nearest neighbours (4 * top_k, at most 40) are routed by section, scored anew by `rerank` (a column over
    text, score and question) where there is one, and the best top_k stay, their texts cut to 1200 characters.
    The answer is `synthesize` (a column over the sources' joined texts), else the best text, else a fixed
    sentence; without sources a single row holds it. Reranking and answering models are the caller's.
    """
    near = vectors.nearest(stored.where(F.col("embedding").isNotNull()), query, vectors.overfetch(top_k))
    hits = near.withColumn("score", F.round(F.exp(-F.col("distance")), 6))
    routed = vectors.route_by_section(hits, section, top_k).withColumn("question", F.lit(question))
    if rerank is not None:
        routed = routed.withColumn("score", rerank)
    # top_k rows are numbered
    top = routed.orderBy(F.col("score").desc(), "distance", "vec_id").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "distance", "vec_id"))
    sources = top.select(rank.alias("rank"), "vec_id", "score", F.substring(F.coalesce("text", F.lit("")), 1, SOURCE_CHARS).alias("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "text")))
    context = F.array_join(F.transform(F.slice(ordered, 1, 5), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n\n")
    first = F.nullif(F.get(ordered, F.lit(0))["text"], F.lit(""))
    said = sources.agg(first.alias("first"), context.alias("context"))
    made = F.nullif(strip(synthesize), F.lit("")) if synthesize is not None else F.lit(None).cast("string")
    answer = said.select(F.coalesce(made, "first", F.lit(NOTHING)).alias("answer"))
    return answer.join(F.broadcast(sources), F.lit(True), "left").select("rank", "vec_id", "score", "text", "answer")


def lexical(rows: DataFrame, question: str, top_k: int = 4) -> DataFrame:
    """(rank, doc_id, page, score, text) without vectors: of the first min(max(6k, 24), 200, 50) rows those that share most words with the question."""
    first = rows.orderBy("doc_id", "page").limit(min(max(6 * top_k, 24), 200, retrieval.MOST_ROWS))
    share = retrieval.overlap_score(F.lit(question), F.col("text"))
    top = first.withColumn("_share", share).orderBy(F.col("_share").desc(), "doc_id", "page").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.col("_share").desc(), "doc_id", "page"))
    return top.select(rank.alias("rank"), "doc_id", "page", F.lit(0.0).alias("score"), F.substring("text", 1, SOURCE_CHARS).alias("text"))


def listing(entries: DataFrame, most: int = LISTED_KEYWORDS) -> DataFrame:
    """entries (doc_name, title, page_count, chunk_count, keywords) with stripped, non-empty keywords, `most` of them, by title and name."""
    words = F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), strip), lambda x: x != "")
    return entries.select(
        strip(F.col("doc_name")).alias("doc_name"), strip(F.col("title")).alias("title"), F.coalesce("page_count", F.lit(0)).alias("page_count"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.slice(words, 1, max(1, most)).alias("keywords"),
    ).orderBy("title", "doc_name")


def file_listing(paths: DataFrame) -> DataFrame:
    """The listing where no entries are stored: the files (path) by name, without anything known of them."""
    name = F.substring_index("path", "/", -1)
    none = F.array().cast("array<string>").alias("keywords")
    return paths.select(name.alias("doc_name"), name.alias("title"), F.lit(0).alias("page_count"), F.lit(0).alias("chunk_count"), none).orderBy("doc_name")


def reattach(results: DataFrame, links: DataFrame) -> DataFrame:
    """results (call, at, and more) with the link that was stored for their call and place, if one was."""
    return results.join(links.select("call", "at", "link"), ["call", "at"], "left")


def mark_counts(marks: DataFrame) -> DataFrame:
    """(url, n) of marks (url, ord, delta of 1 or -1) taken in order: a count never falls below 0, and urls at 0 go.

    The last count is the running sum less the least one so far, where that is negative.
    """
    w = Window.partitionBy("url").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.withColumn("run", F.sum("delta").over(w)).groupBy("url").agg(F.max_by("run", "ord").alias("last"), F.min("run").alias("least"))
    return run.select("url", (F.col("last") - F.least("least", F.lit(0))).alias("n")).where("n > 0")


def unexpired(cache: DataFrame, now: Column, ttl: float = 3600, most: int = 1000) -> DataFrame:
    """cache (key, stored: seconds, value) as it can be used: the last value of each key, no older than ttl, the newest `most` of them (the cache's size)."""
    last = cache.groupBy("key").agg(F.max_by(F.struct("stored", "value"), "stored").alias("r")).select("key", "r.*")
    return last.where(F.col("stored") > now - ttl).orderBy(F.col("stored").desc(), "key").limit(most)
