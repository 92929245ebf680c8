"""What builders and stores keep between their steps, and for how long."""

import os

from pyspark.sql import functions as F

from tessella.operators import builders, ingest
from tessella.plans import built
from tessella.session import kept, release, shared_folder
from tests.conftest import SF


def held(spark, word="tessella-kept"):
    top = shared_folder(spark).removeprefix("file:")
    return {x for x in os.listdir(top) if x.startswith(word)} if os.path.isdir(top) else set()


def docs(spark, n):
    return spark.createDataFrame([(i, f"doc {i}.pdf", "\f".join(f"{p}. Part {p}\nword{i} text of page {p}" for p in range(1, 5))) for i in range(n)], "doc_id long, doc_name string, text string")


def test_kept_tables_are_compressed_and_can_be_released(spark):
    df = spark.range(20_000).select("id", F.lit("the same text again").alias("t"))
    before = held(spark)
    t = kept(df)
    (name,) = held(spark) - before
    folder = f"{shared_folder(spark).removeprefix('file:')}/{name}"
    assert sum(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder)) < 20_000 * 10 and t.count() == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    release(t)
    assert held(spark) == before


def test_ingest_leaves_nothing_but_the_store(spark, tmp_path):
    before = held(spark)
    s = ingest.Store(spark, f"file://{tmp_path}/store")
    assert builders.ingest(s, docs(spark, 6)) == 6 and builders.ingest(s, docs(spark, 8)) == 2
    assert held(spark) == before and s.read("entries").where("size(keywords) > 0").count() == 8


def test_pages_are_kept_once_while_documents_are_built(spark, monkeypatch):
    before, steps, cut = held(spark), [], builders.cut_lineage
    monkeypatch.setattr(builders, "cut_lineage", lambda df: (steps.append(df), cut(df))[1])
    made = builders.build(docs(spark, 4))
    # what remains is what the result reads, and no step but one keeps both a text and what it is made of
    assert len(held(spark) - before) == 5
    assert not [df.columns for df in steps if {"text", "body"} <= set(df.columns)]
    assert made.entries.where("pages = 4").count() == 4
    made.release()
    assert held(spark) == before


def test_chaptered_documents_are_made_without_a_shuffle(spark, capsys):
    built.chaptered(spark, SF).explain()
    assert "Exchange" not in capsys.readouterr().out
