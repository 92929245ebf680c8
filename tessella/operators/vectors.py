"""Nearest neighbours over embeddings: exact, by sections, by clusters; and re-scoring by structure."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import cut_lineage, ship_package


def squared_distance(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest of vectors (vec_id, embedding, ...), with distance; one pass, k rows per partition."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", F.round(squared_distance(F.col("embedding"), q), 6)).orderBy("distance", "vec_id").limit(k)


def overfetch(k: int, document_search: bool = False) -> int:
    """How many neighbours to fetch for k results."""
    return min(max(6 * k, 24), 80) if document_search else min(max(4 * k, k), 40)


def section_scores(hits: DataFrame, section: str) -> DataFrame:
    return hits.where(F.col(section).isNotNull()).groupBy(section).agg(F.max("score").alias("section_score"))


def route_by_section(hits: DataFrame, section: str, top_k: int, sections: int = 3) -> DataFrame:
    """Hits of the sections with the largest score sums, if these are top_k or more; else all hits."""
    sums = hits.groupBy(section).agg(F.sum("score").alias("total")).orderBy(F.col("total").desc(), section).limit(sections)
    routed = hits.join(F.broadcast(sums.select(section)), section, "left_semi")
    enough = routed.agg((F.count("*") >= top_k).alias("enough"))
    marked = hits.join(F.broadcast(sums.select(section, F.lit(True).alias("_in"))), section, "left").join(F.broadcast(enough))
    return marked.where(~F.col("enough") | F.col("_in").isNotNull()).drop("_in", "enough")


def boosted_score(section: Column, parent: Column, path: Column, query: Column, text: Column) -> Column:
    """The larger of section and parent, 0.2 for the whole query inside the text, and the path's score."""
    z = F.lit(0.0)
    hit = F.when(F.contains(F.lower(text), F.lower(query)), F.lit(0.2)).otherwise(z)
    return F.greatest(F.coalesce(section, z), F.coalesce(parent, z)) + hit + F.coalesce(path, z)


def merge_sources(hits: DataFrame, source: str, k: int, id_col: str) -> DataFrame:
    """The best k over all sources, each row marked if its source's first hit is the best of all."""
    w = Window.partitionBy(source).orderBy(F.col("score").desc(), id_col)
    top = hits.withColumn("at", F.row_number().over(w)).where(F.col("at") <= k)
    chosen = top.where("at = 1").orderBy(F.col("score").desc(), source).limit(1).select(F.col(source).alias("_chosen"))
    ranked = top.orderBy(F.col("score").desc(), source, id_col).limit(k)
    return ranked.join(F.broadcast(chosen)).withColumn("answers", F.col(source) == F.col("_chosen")).drop("_chosen", "at")


def clustered(vectors: DataFrame, lists: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(vectors with cell, cells with centre) by k-means; with fewer vectors than lists, one cell."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    if vectors.limit(lists).count() < lists:
        return vectors.withColumn("cell", F.lit(0)), spark.createDataFrame([(0, None)], "cell int, centre array<double>")
    rows = vectors.withColumn("_v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="cell", maxIter=10).fit(rows)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return model.transform(rows).drop("_v"), spark.createDataFrame(centres, "cell int, centre array<double>")


#: Cells at most, pairs of blocks that are broadcast, queries of a block, vectors that meet it in one step.
MOST_CELLS, BROADCAST_PROBES, BLOCK_QUERIES, BLOCK_VECTORS = 65_536, 50_000, 2048, 8192


def cells_for(rows: int) -> int:
    """About the square root of the vectors' number."""
    return max(1, min(MOST_CELLS, round(rows**0.5)))


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as a matrix of doubles."""
    flat = pc.list_flatten(c).to_numpy().astype("float64")
    return flat.reshape(len(c), -1) if len(flat) else np.zeros((len(c), 0))


def _rounded(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, added up in the order of squared_distance."""
    d = np.zeros(len(v))
    for i in range(v.shape[1]):
        d += (v[:, i] - q[:, i]) ** 2
    return d


def _met(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance): of each pair of blocks the k nearest vectors of each query, those farther than its bound aside.

    vectors: vec_id, embedding, vblock; queries: query_id, query, qblock, bound (a distance, or null); pairs: vblock, qblock, each once. A pair of
    blocks is one step of bounded memory: a product of matrices finds those that can be among the k, whose distances are then computed as elsewhere.
    """
    kind, other = queries.schema["query_id"].dataType.simpleString(), vectors.schema["vec_id"].dataType.simpleString()

    def step(v: pa.Table, q: pa.Table) -> pa.Table:
        owner, near, far = [], [], []
        if len(v) and len(q):
            a, b = _matrix(v.column("embedding")), _matrix(q.column("query"))
            ids = v.column("vec_id").to_numpy()
            limit = q.column("bound").to_numpy().astype("float64")
            limit = np.where(np.isnan(limit), np.inf, limit)
            for lo in range(0, len(a), BLOCK_VECTORS):  # a block that equal vectors have made large is taken in parts
                part, names = a[lo : lo + BLOCK_VECTORS], ids[lo : lo + BLOCK_VECTORS]
                d = (b * b).sum(1)[:, None] + (part * part).sum(1)[None, :] - 2 * (b @ part.T)
                kth = np.partition(d, min(k, len(part)) - 1, axis=1)[:, min(k, len(part)) - 1]
                rows, columns = np.nonzero(d <= (np.minimum(limit, kth) + 2e-6)[:, None])
                owner.append(rows), near.append(names[columns]), far.append(_rounded(part[columns], b[rows]))
        empty = not owner
        who = np.concatenate(owner) if not empty else np.zeros(0, "int64")
        columns = [q.column("query_id").take(pa.array(who)), pa.array(np.concatenate(near) if not empty else []).cast(v.schema.field("vec_id").type), pa.array(np.concatenate(far) if not empty else [], pa.float64())]
        return pa.table(columns, names=["query_id", "vec_id", "distance"])

    ship_package(vectors.sparkSession)
    pairs = cut_lineage(pairs)
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_PROBES else pairs
    own = [F.col(c).alias(f"_{c}") for c in ("vblock", "qblock")]  # both sides come from the pairs
    left = vectors.join(pairs, "vblock").select(*own, "vec_id", "embedding")
    right = queries.join(pairs, "qblock").select(*own, "query_id", "query", F.col("bound").cast("double").alias("bound"))
    got = left.groupBy("_vblock", "_qblock").cogroup(right.groupBy("_vblock", "_qblock")).applyInArrow(step, f"query_id {kind}, vec_id {other}, distance double")
    top = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return got.withColumn("distance", F.round("distance", 6)).withColumn("_at", F.row_number().over(top)).where(F.col("_at") <= k)


def probe(vectors: DataFrame, cells: DataFrame, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """(query_id, vec_id, distance): each query's k nearest, exactly. queries: (query_id, query).

    After the cells with the nearest centres, all cells follow that could hold a nearer vector by the
    triangle inequality: those whose centre is no farther than their radius and the k-th distance so far. Queries of the same
    nearest cell stand in blocks together; a cell is looked at by a block if one of its queries asks for it.
    """
    root = F.sqrt(squared_distance(F.col("embedding"), F.col("centre")))
    radius = vectors.join(F.broadcast(cells), "cell").groupBy("cell").agg(F.max(F.coalesce(root, F.lit(0.0))).alias("radius"))
    known = [(r["cell"], r["centre"], r["radius"]) for r in cells.join(radius, "cell").collect()]  # at most MOST_CELLS centres
    names, radii = np.array([c for c, _, _ in known], "int32"), np.array([r for _, _, r in known])
    centres = np.array([c if c is not None else [] for _, c, _ in known], "float64")
    n = max(1, -(-queries.count() // BLOCK_QUERIES))
    most = min(probes, len(names))

    def to_centres(q: pa.Array) -> np.ndarray:
        b = _matrix(pa.chunked_array([q]))
        if not centres.shape[1]:
            return np.zeros((len(b), len(names)))
        return np.sqrt(np.maximum((b * b).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (b @ centres.T), 0))

    def nearest_cells(batches):
        for b in batches:
            order = np.argsort(to_centres(b.column(1)), axis=1, kind="stable")[:, :most]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[order].tolist(), pa.list_(pa.int32()))], names=["query_id", "query", "near"])

    def reached(batches):
        for b in batches:
            bound = b.column(3).to_numpy(zero_copy_only=False).astype("float64")
            reach = np.sqrt(np.where(np.isnan(bound), np.inf, bound) + 1e-6)
            hit = to_centres(b.column(1)) <= radii[None, :] + reach[:, None] + 1e-5
            rows, columns = np.nonzero(hit)
            pairs = np.unique(np.stack([b.column(2).to_numpy()[rows].astype("int64"), names[columns].astype("int64")]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].astype("int32")), pa.array(pairs[0].astype("int32"))], names=["vblock", "qblock"])

    ship_package(vectors.sparkSession)
    kind = queries.schema["query_id"].dataType.simpleString()
    shape = queries.schema["query"].dataType.simpleString()
    placed = queries.select("query_id", "query").mapInArrow(nearest_cells, f"query_id {kind}, query {shape}, near array<int>")
    placed = placed.withColumn("qblock", F.ntile(n).over(Window.orderBy(F.col("near")[0], "query_id"))) if n == 1 else placed.repartitionByRange(n, F.col("near")[0], "query_id").withColumn("qblock", F.spark_partition_id())
    placed = cut_lineage(placed.withColumn("qblock", F.col("qblock").cast("int")))
    v = vectors.select("vec_id", "embedding", F.col("cell").alias("vblock"))
    first = placed.select("qblock", F.explode("near").alias("vblock")).distinct()
    near = cut_lineage(_met(v, placed.withColumn("bound", F.lit(None).cast("double")), first, k))
    asked = placed.drop("near").join(near.where(F.col("_at") == k).select("query_id", F.col("distance").alias("bound")), "query_id", "left")
    asked = cut_lineage(asked.select("query_id", "query", "qblock", "bound"))
    rest = asked.mapInArrow(reached, "vblock int, qblock int").distinct().join(first, ["vblock", "qblock"], "left_anti")
    top = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    both = near.unionByName(_met(v, asked, rest, k)).withColumn("_at", F.row_number().over(top))
    return both.where(F.col("_at") <= k).select("query_id", "vec_id", "distance")


def hash_embedding(text: Column, size: int = 1536) -> Column:
    """A vector made of the text alone, where no model answers: bytes of a chain of SHA-256 hashes, from -1 to 1."""
    links = -(-size // 32)
    first = F.sha2(F.encode(F.coalesce(text, F.lit("")), "utf-8"), 256)
    start = F.struct(first.alias("h"), F.lit("").alias("all"))

    def link(s, _):
        h = F.sha2(F.unhex(s["h"]), 256)
        return F.struct(h.alias("h"), F.concat(s["all"], h).alias("all"))

    chain = F.aggregate(F.sequence(F.lit(1), F.lit(links)), start, link, lambda s: s["all"])
    byte = lambda i: F.conv(F.substring(chain, i * 2 + 1, 2), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: byte(i) / 255.0 * 2.0 - 1.0)


def document_scores(hits: DataFrame) -> DataFrame:
    """(doc_id, score) of hits (doc_id, section_id, score): the best section's."""
    return hits.where("doc_id is not null").groupBy("doc_id").agg(F.max("score").alias("score"))
