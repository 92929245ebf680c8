import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.operators import vectors
from tessella.plans import QUERIES
from tests.conftest import SF


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in QUERIES["ivf_probe"](spark, path).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    wanted = [i for i in ids if i % 50 == 0]
    assert sorted(got) == sorted(wanted)
    hits = total = 0
    for i in wanted:
        d = np.round(((m - m[ids == i]) ** 2).sum(1), 6)
        best = {int(ids[j]) for j in np.lexsort((ids, d))[:10]}
        hits, total = hits + len(best & got[i]), total + len(best)
    assert hits >= 0.9 * total


def test_probing_without_broadcast(spark, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    cells, centres = vectors.clustered(e, vectors.cells_for(e.count()))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    near = lambda: sorted(map(tuple, vectors.probe(cells, centres, queries, 5).collect()))
    small = near()
    monkeypatch.setattr(vectors, "BROADCAST_PROBES", 0)
    assert near() == small and vectors.cells_for(10**12) == vectors.MOST_CELLS


def test_equal_pages_and_maps_keep_their_records(spark):
    from tessella.functions import web

    df = spark.createDataFrame([(1, {"a": 1}, '<a href="http://x">t</a>')] * 2, "page_id int, m map<string,int>, html string")
    got = web.records(df, r'<a href="(?P<link>[^"]*)">(?P<title>.*?)</a>').collect()
    assert [(r.page_id, r.m, r["at"], r.link, r.title) for r in got] == [(1, {"a": 1}, 1, "http://x", "t")] * 2
