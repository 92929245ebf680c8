import pytest
from pyspark.sql import functions as F

from tessella.functions import access, text, web
from tessella.operators import chunking, keywords, retrieval, store, vectors


def one(spark, c, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(c).first()[0]


@pytest.mark.parametrize(
    ("line", "want"),
    [("Aims....12", ("Aims", 12, 1)), ("Aims .... 12", ("Aims ....", 12, 1)), ("Aims | 7 |", ("Aims", 7, 1)), ("1.2 Means\t9", ("1.2 Means", 9, 2)), ("The mix", ("The", 1009, 1)), ("plain words", None), ("Contents 3", None), ("", None)],
)
def test_toc_entry(spark, line, want):
    got = one(spark, text.toc_entry(F.col("x")), x=line)
    assert (tuple(got) if got else None) == want


def test_contents_page(spark):
    assert one(spark, text.is_contents_page(F.col("x")), x="TABLE of Contents\nabc")
    assert one(spark, text.is_contents_page(F.col("x")), x="a .. 1\nb .. 2\nwords here\n")
    assert not one(spark, text.is_contents_page(F.col("x")), x="words here\nmore words")


def test_clean_and_strip(spark):
    assert one(spark, text.clean_document(F.col("x")), x="  a\r\n\r\n\r\n\nb\x00\t  c ") == "a\n\nb c"
    assert one(spark, text.heading_title(F.col("x")), x="## A  title.....xii") == "A title"


def test_access(spark):
    doc = '{"items": [{"name": "a"}, {"name": "b", "_url": "u"}], "3": 7}'
    get = lambda chain: one(spark, access.access(F.col("j"), chain), j=doc)
    assert get("items[1].name") == "a" and get("items[-1]['name']") == "b" and get("items[2].link") == "u" and get("items[9]") is None
    with pytest.raises(ValueError):
        access.steps("a[0]")
    assert one(spark, access.regex_pipe(F.col("j"), r"x=(\d)", "<$1>"), j="a\nx=5") == "<5>"
    assert one(spark, access.regex_pipe(F.col("j"), r"y"), j="a") == ""


def test_web(spark):
    assert one(spark, web.unescape(F.col("x")), x="a &amp; &eacute;") == "a & é"
    assert one(spark, web.set_query_parameter(F.col("x"), "a", "1 2"), x="http://h/p?a=0&b=&a=3#f") == "http://h/p?a=1+2&b=&a=1+2#f"


def test_split_budget():
    assert chunking.split_budget(None) == [] and chunking.split_budget(" a ") == ["a"]
    pieces = chunking.split_budget("word " * 500, 200)
    assert all(len(p) <= 200 for p in pieces) and " ".join(pieces) == ("word " * 500).strip()
    assert chunking.split_budget("x" * 450, 200) == ["x" * 200, "x" * 200, "x" * 50]
    assert len(chunking.split_budget("x" * 450, 200, overlap=50)) == 3


def test_tiers_and_names(spark):
    names = spark.createDataFrame([("a/b.txt",), ("c/b.txt",), ("b",), ("d/b.md",)], "name string")
    tier = lambda q: sorted(r.name for r in retrieval.best_tier(names, q).collect())
    assert tier("b") == ["b"] and tier("b.txt") == ["a/b.txt", "c/b.txt"] and tier("B.MD") == ["d/b.md"] and tier("zz") == []
    batch = spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "y")], "ord int, name string")
    got = store.free_names(batch, batch.where("ord = 1").select("name")).orderBy("ord").collect()
    assert [r.target for r in got] == ["x_1.pdf", "x_2.pdf", "y"]


def test_limits(spark):
    assert one(spark, keywords.keyword_limit(F.lit(10), 3, 0.5), x=1) == 3 and one(spark, keywords.keyword_limit(F.lit(10), -1, -1.0), x=1) == 10
    assert (vectors.overfetch(4), vectors.overfetch(4, True), vectors.overfetch(99, True)) == (16, 24, 80)
    parts = spark.range(10).select(chunking.contiguous_part(F.col("id"), F.lit(10), 4).alias("p")).collect()
    assert [r.p for r in parts] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3]
