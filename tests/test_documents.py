import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import markdown, mathematics, nested
from tessella.operators import alignment, answers, catalog, ingest, segmentation, sessions, store, trees
from tests.conftest import SF


def one(spark, c, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(c).first()[0]


# ---- trees
def test_deep_trees(spark):
    rows = [("d", i, f"t{i}", i) for i in range(1, 41)] + [("d", 41, "back", 3)]
    nodes = spark.createDataFrame(rows, "doc string, ord int, title string, level int")
    edges = catalog.tree_edges(nodes)
    assert {r.ord: r.parent for r in edges.collect()} == {i: (i - 1 or None) for i in range(1, 41)} | {41: 2}
    got = {(r.node, r.ancestor): r.distance for r in catalog.closure(edges).collect()}
    want = {(i, j): i - j for i in range(1, 41) for j in range(1, i + 1)} | {(41, 41): 0, (41, 2): 1, (41, 1): 2}
    assert got == want
    paths = {r.ord: r.path for r in catalog.paths(nodes).collect()}
    assert paths[40] == "/".join(f"t{i}" for i in range(1, 41)) and paths[41] == "t1/t2/back"
    assert catalog.closure(edges.limit(0)).count() == 0


def brute_split(text, page, markers):
    """markers: (ord, title, level, path, page) in order; as split_pages says, on one page of plain headings."""
    lines = text.split("\n")
    key = lambda s: "".join(c for c in s.lower() if c.isalnum())
    hits = sorted((lines.index(t), o, t, lv, p) for o, t, lv, p, pg in markers if pg == page and t in lines)
    if not hits or (len(hits) == 1 and hits[0][0] == 0):
        return [((hits[0][2] if hits else ""), text.strip())]
    out = [(h[2], h[3], "\n".join(lines[h[0] : hits[i + 1][0] if i + 1 < len(hits) else len(lines)]).strip()) for i, h in enumerate(hits)]
    prefix = "\n".join(lines[: hits[0][0]]).strip()
    prior = [m for m in markers if m[0] < hits[0][1]]
    if prefix and prior:
        out.insert(0, (prior[-1][1], 0, prefix))
    elif prefix and "/" in hits[0][4]:
        out[0] = (out[0][0], out[0][1], f"{prefix}\n{out[0][2]}")
    elif prefix:
        out.insert(0, ("", 0, prefix))
    if len(out) > 1 and out[0][1] == 1 and out[1][1] > 1 and len(out[0][2].split("\n")) == 1:
        out = out[1:]
    return [(t, x) for t, _, x in out] if len(out) > 1 else [(hits[0][2], text.strip())]


def test_split_pages(spark):
    pages = [
        (1, "Chapter 1 Aims\n1.1 Scope\nsome body text here\n1.2 Means\nmore body text"),
        (2, "left over from before\nand more\nChapter 2 Ends\nlast words of it"),
        (3, "no heading on this page\nat all"),
        (4, "2.1 Tail"),
    ]
    m = [(1, "Chapter 1 Aims", 1, 1), (2, "1.1 Scope", 1, 2), (3, "1.2 Means", 1, 2), (4, "Chapter 2 Ends", 2, 1), (5, "2.1 Tail", 4, 2)]
    p = spark.createDataFrame([("a", n, t) for n, t in pages], "doc string, page int, text string")
    marks = spark.createDataFrame([("a", *x) for x in m], "doc string, ord int, title string, page int, level int")
    path = {1: "Chapter 1 Aims", 2: "Chapter 1 Aims/1.1 Scope", 3: "Chapter 1 Aims/1.2 Means", 4: "Chapter 2 Ends", 5: "Chapter 2 Ends/2.1 Tail"}
    brute = [(o, t, lv, path[o], pg) for o, t, pg, lv in m]
    got = {}
    for r in trees.split_pages(p, marks).orderBy("page", "fragment").collect():
        got.setdefault(r.page, []).append((r.title, r.text))
    assert got == {n: brute_split(t, n, brute) for n, t in pages}
    assert len(got[1]) == 2 and len(got[2]) == 2 and got[2][0][0] == "1.2 Means"
    first = trees.split_pages(p.where("page = 2"), marks.where("ord = 5")).collect()
    assert len(first) == 1 and first[0]["count"] == 1
    # a nested first hit takes what stands before it
    nested_first = spark.createDataFrame([("a", 1, "before\n1.1 Scope\nbody\n1.2 Means\nbody two")], p.schema)
    deep = spark.createDataFrame([("a", 1, "1.1 Scope", 1, 2), ("a", 2, "1.2 Means", 1, 2)], marks.schema)
    got = [(r.title, r.text) for r in trees.split_pages(nested_first, deep).orderBy("fragment").collect()]
    assert got == [("", "before"), ("1.1 Scope", "1.1 Scope\nbody"), ("1.2 Means", "1.2 Means\nbody two")]


def test_document_tree(spark):
    pages = [("a", 1, "cover", "c"), ("a", 2, "catalogue", "t1"), ("a", 3, "catalogue", "t2"), ("a", 4, "content", "x"), ("a", 5, "content", "y"), ("a", 9, "content", "z")]
    ranges = [("a", 1, "One", 4, 6, 1, "text-pattern"), ("a", 2, "Deep", 5, 5, 2, "text-pattern"), ("a", 3, "Gone", 6, 6, 2, "text-pattern"), ("a", 4, "Kept", 7, 7, 1, "manual-toc")]
    p = spark.createDataFrame(pages, "doc string, page int, category string, text string")
    r = spark.createDataFrame(ranges, "doc string, ord int, title string, start int, end int, level int, kind string")
    t = trees.document_trees(p, r)
    rows = [(x.kind, x.category, x.title, x.start, x.end, x.depth, x.text) for x in t.orderBy("at").collect()]
    assert rows == [
        ("page", "cover", "封面", 1, 1, 1, "c"), ("chapter", "chapter", "目录", 2, 3, 1, None), ("page", "catalogue", "目录", 2, 2, 2, "t1"), ("page", "catalogue", "目录", 3, 3, 2, "t2"),
        ("chapter", "chapter", "One", 4, 5, 1, None), ("page", "content", "", 4, 4, 2, "x"), ("chapter", "chapter", "Deep", 5, 5, 2, None), ("page", "content", "", 5, 5, 3, "y"),
        ("chapter", "chapter", "Kept", 7, 7, 1, None), ("page", "content", "", 9, 9, 1, "z"),
    ]
    listed = [(x.title, x.page, x.end_page, x.level, x.parent_title) for x in trees.catalog_payload(t).orderBy("ord").collect()]
    assert listed == [("目录", 2, 3, 1, None), ("One", 4, 5, 1, None), ("Deep", 5, 5, 2, "One"), ("Kept", 7, 7, 1, None)]
    text = trees.export_markdown(t).first().markdown
    assert "## One\n\n页码范围: 4-5\n\n### One\n\n页码: 4\n\n正文:\n\nx\n\n### Deep\n\n页码范围: 5\n\n#### Deep\n\n页码: 5\n\n正文:\n\ny" in text
    assert text.count("### 目录") == 1  # the second contents page has no heading of its own
    bare = trees.catalog_payload(trees.document_trees(p.where("page > 3"), r.limit(0))).collect()
    assert [(x.title, x.page, x.level) for x in bare] == [("Page 1", 4, 1), ("Page 2", 5, 1), ("Page 3", 9, 1)]


# ---- alignment
def test_align():
    assert alignment.align(["a", "b", "c"], ["a", "x", "b", "c"]) == {1: 1, 2: 3, 3: 4}
    assert alignment.align(["a", "x", "b"], ["a", "b"]) == {1: 1, 2: 1, 3: 2}
    assert alignment.align(["a", "", "b"], ["a", "", "b"]) == {1: 1, 2: 3, 3: 3}
    assert alignment.align(["p"], ["q"]) == {} and alignment.align([], ["q"]) == {}
    assert alignment.align(["a", "b", "c", "d"], ["a", "b"]) == {1: 1, 2: 2, 3: 2, 4: 2}
    assert alignment.same_page("heading one|x", "heading one|y") and not alignment.same_page("abc|x", "abd|x") and alignment.same_page("introduction", "theintroductionpart|z")


def test_anchors(spark):
    rows = [("a", 1, 1, 1, 3), ("a", 2, 4, 2, None), ("a", 3, 7, 1, 9), ("a", 4, 12, 2, None), ("b", 1, 5, 1, 6), ("b", 2, 6, 2, None)]
    m = spark.createDataFrame(rows, "doc string, ord int, page int, level int, hit int")
    assert {(r.doc, r.ord): r.mapped for r in alignment.interpolate(m, 12).collect()} == {("a", 1): 3, ("a", 2): 6, ("a", 3): 9, ("a", 4): 12, ("b", 1): 5, ("b", 2): 6}
    marks = spark.createDataFrame([("a", 1, "One", 1, 1), ("a", 2, "Two", 4, 1), ("a", 3, "Three", 5, 1)], "doc string, ord int, title string, page int, level int")
    heads = spark.createDataFrame([("a", 2, "one"), ("a", 6, "two"), ("a", 6, "three"), ("a", 9, "three")], "doc string, page int, key string")
    assert [r.page for r in alignment.look_ahead(marks, heads, 8).orderBy("ord").collect()] == [2, 4, 6]
    toc = spark.createDataFrame([("a", "ONE", 7), ("a", "One", 3)], "doc string, title string, page int")
    assert [r.page for r in alignment.toc_pages(toc, marks).orderBy("ord").collect()] == [3, 4, 5]


# ---- answers
def test_results(spark):
    e = answers.empty_result(spark, "q", regex="x", page_end=3).first()
    assert (e["query"], e["count"], e.results, e.filters.regex, e.filters.page_end, e.filters.section) == ("q", 0, [], "x", 3, None)
    with pytest.raises(ValueError):
        answers.empty_result(spark, "q", other=1)
    rows = spark.createDataFrame([(i, "s", f"{i}::p", str(i), 1, 1, 1, f"text {i}") for i in range(60)], "doc_id long, section string, section_id string, parent_section_id string, page int, page_start int, page_end int, text string")
    got = answers.retrieve(rows, regex="text", limit=99).first()
    assert got["count"] == 60 and [r.doc_id for r in got.results] == list(range(50))
    hits = spark.createDataFrame([(3, "3", 0.5), (3, "3", 0.7), (4, "4::p", 0.9), (5, "s", 0.1)], "doc_id long, section_id string, score double")
    got = answers.retrieve(rows, "Text 4", hits, limit=5).first()
    assert [(r.doc_id, round(r.score, 6)) for r in got.results] == [(4, 1.1), (3, 0.7), (5, 0.1)] and got["count"] == 3
    assert answers.retrieve(rows, " ", hits).first()["count"] == 0
    names = spark.createDataFrame([(7, "a/b.txt"), (8, "b.md")], "doc_id long, name string")
    assert [r.doc_id for r in answers.retrieve(rows, names=names, doc_name="b.txt").first().results] == [7]


def test_ask_and_gate(spark):
    rows = [(i, [float(i), 0.0], i % 2, f"t{i}" * 700) for i in range(6)]
    stored = spark.createDataFrame(rows, "vec_id long, embedding array<float>, section int, text string")
    got = answers.ask(stored, [0.0, 0.0], "q", 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1] and got[0].answer == ("t0" * 700)[:1200] == got[0].text
    made = answers.ask(stored, [0.0, 0.0], "q", 2, synthesize=F.concat(F.lit(" said: "), F.substring("context", 1, 6))).first()
    assert made.answer == "said: [1] t0"
    nothing = answers.ask(stored.limit(0), [0.0, 0.0], "q").collect()
    assert len(nothing) == 1 and nothing[0].answer == answers.NOTHING and nothing[0].rank is None
    s = spark.createDataFrame([(1, 0.9, "x"), (2, 0.9, "y"), (3, 0.1, "z")], "rank int, score double, text string")
    assert answers.gate(s).first().answer == "x" and answers.gate(s.where("rank < 3")).first().answer is None
    marks = spark.createDataFrame([("u", i, d) for i, d in enumerate([-1, 1, 1, -1, -1, -1, 1])] + [("v", 1, -1)], "url string, ord int, delta int")
    assert [(r.url, r.n) for r in answers.mark_counts(marks).collect()] == [("u", 1)]


# ---- stores
def test_store(spark, tmp_path):
    dbs = ingest.Databases(spark, str(tmp_path / "root"))
    assert dbs.names() == []
    s = dbs.create("one")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 20").select("doc_id", F.format_string("doc %d", "doc_id").alias("doc_name"), "text")
    ingest.load_or_build(s, docs.where("doc_id < 10"))
    first = s.version()
    assert ingest.load_or_build(s, docs).version() == first and s.read("entries").count() == 10
    ingest.add(s, docs)
    assert s.read("entries").count() == 20 and s.version() > first
    chunks = s.read("chunks").count()
    ingest.add(s, docs)  # known already
    assert s.read("chunks").count() == chunks and s.read("registry").count() == 20
    ingest.remove_documents(s, spark.createDataFrame([(3,)], "doc_id long"))
    assert s.read("entries").where("doc_id = 3").count() == 0 and s.read("chunks").where("doc_id = 3").count() == 0 and s.read("registry").count() == 19
    old = s.read("entries").withColumn("keyword_version", F.lit(0)).withColumn("keywords", F.array(F.lit("x")))
    fresh = ingest.refresh_keywords(old, docs).collect()
    assert all(r.keyword_version == 1 and r.keywords != ["x"] for r in fresh)
    dbs.create("two")
    assert {(r.name, r.documents) for r in dbs.statistics().collect()} == {("one", 19), ("two", 0)}
    assert dbs.select(["two", "zz", "two"]) == ["two"] and dbs.select([]) == ["one", "two"]
    dbs.rename("two", "three")
    dbs.delete("three")
    assert dbs.names() == ["one"]
    for bad in ("", "../x", "a b"):
        with pytest.raises(ValueError):
            dbs.create(bad)
    assert ingest.rebuild(s, docs.limit(3)).read("entries").count() == 3
    assert one(spark, ingest.json_safe(F.col("x")), x="a\x00b\n\x1fc") == "ab\nc"


def test_upsert_and_names(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "z", 1), (2, "c", 2), (None, "n", 3), (4, "d", 4)], old.schema)
    assert sorted((r.k or 0, r.v) for r in store.upsert(old, new, "k", "o").collect()) == [(0, "n"), (1, "a"), (2, "c"), (4, "d")]
    batch = spark.createDataFrame([(1, "x.pdf"), (2, "x.pdf"), (3, "x_1.pdf"), (4, "y"), (5, "x_2.pdf")], "ord int, name string")
    there = spark.createDataFrame([("x.pdf",), ("x_1.pdf",), ("y.b",)], "name string")
    got = [r.target for r in store.free_names(batch, there).orderBy("ord").collect()]
    assert got == ["x_2.pdf", "x_3.pdf", "x_1_1.pdf", "y", "x_2_1.pdf"]


# ---- sessions
def test_call_log(spark):
    e = [("s", i, *r) for i, r in enumerate([("start", "a"), ("end", "b"), ("start", "a"), ("end", "a"), ("end", "a"), ("end", "a"), ("start", "a"), ("start", "c")])]
    rows = spark.createDataFrame([(s, o, k, c, "tool", f"x{o}") for s, o, k, c in e], "session string, ord int, kind string, call_id string, tool string, text string")
    open_, want = {}, {}
    for _, o, kind, c in e:  # the latest open record of an identifier is closed
        if kind == "start":
            want[o] = None
            open_.setdefault(c, []).append(o)
        elif open_.get(c):
            want[open_[c].pop()] = o
    got = {r.started: r.ended for r in sessions.call_log(rows).collect()}
    assert got == want
    out = {r.started: (r.input, r.output) for r in sessions.call_log(rows).collect()}
    assert out[2] == ("x2", "x3") and out[0] == ("x0", "x4")


# ---- values
def test_nested(spark):
    assert nested.pruned({"a": [None, "", {"b": []}], "c": 0, "d": False, "e": {"f": ""}}) == {"c": 0, "d": False}
    assert nested.pruned([]) is None and nested.pruned("x") == "x" and nested.pruned(0) == 0
    v = lambda x: tuple(one(spark, nested.json_or_text(F.col("x")), x=x))
    assert v('{"a": 1}') == ("object", '{"a":1}') and v("[1]") == ("array", "[1]") and v(' a "b ') == ("text", json.dumps('a "b')) and v("") == ("text", '""')
    outputs = [{"items": [{"link": "x", "_url": "http://u/7"}]}, "plain 12 and 34"]
    r = lambda x: nested.resolve(x, outputs)
    assert r("tool[1].items[1].link") == "http://u/7" and r("tool[-1]") == "plain 12 and 34" and r("no tool[1]") == "no tool[1]"
    assert r({"a": ["tool[2] | regex '(\\d+) and (\\d+)' $2-$1"]}) == {"a": ["34-12"]} and r("tool[2] | regex zz") == ""
    for bad in ("tool[0]", "tool[9]", "tool[1].nope", "tool[1].items[0]", "tool[2] | upper"):
        with pytest.raises((KeyError, ValueError)):
            r(bad)
    calls = spark.createDataFrame([("s", 1, '{"a": [5, 6]}', True), ("s", 2, "open", False)], "session string, ord int, output string, ended boolean")
    inputs = spark.createDataFrame([("s", 1, "tool[1].a[-1]"), ("s", 2, "tool[2]"), ("t", 1, "as is")], "session string, id int, input string")
    got = {(x.session, x.id): (x.resolved, x.error is None) for x in nested.resolve_inputs(inputs, calls).collect()}
    assert got == {("s", 1): ("6", True), ("s", 2): (None, False), ("t", 1): ("as is", True)}
    assert one(spark, nested.front_matter(F.col("x")), x="---\nname: 'A b'\nother: c: d\n---\nbody: no") == {"name": "A b", "other": "c: d"}
    assert one(spark, nested.front_matter(F.col("x")), x="body") == {}
    assert [tuple(t) for t in one(spark, nested.image_tokens(F.col("x")), x="![a](image://page-3/1) image://page-12/2")] == [(3, 1), (12, 2)]
    image = nested.encode_image(b"abc")
    assert nested.decode_image(image) == b"abc" and nested.decode_image({"data": "%%"}) == b""
    tools = spark.createDataFrame([("rag_b",), ("x",), ("rag_a",), ("x",), ("y",)], "name string")
    assert [t.name for t in nested.allowed_tools(tools, ["x"]).collect()] == ["rag_a", "rag_b", "x"] and nested.allowed_tools(tools, []).count() == 4
    todo = spark.createDataFrame([("l", 1, "a", ["b", "c"]), ("l", 2, "d", None)], "list string, ord int, text string, children array<string>")
    assert [(t.id, t.text) for t in nested.flatten_todos(todo).orderBy("id").collect()] == [(1, "a"), (2, "↳ b"), (3, "↳ c"), (4, "d")]


def test_assets(spark):
    rows = [("d1", "", "", ""), ("", "n", "", ""), ("d1", "other", "", ""), ("", "", "", ""), (None, "n", "cap", "")]
    df = spark.createDataFrame([([dict(zip(("data", "name", "caption", "source"), r)) for r in rows],)], "a array<struct<data:string,name:string,caption:string,source:string>>")
    got = df.select(nested.distinct_assets(F.col("a"))).first()[0]
    assert [(x.data or "", x.name or "") for x in got] == [("d1", ""), ("", "n")]
    texts = spark.createDataFrame([("d", "image://page-1/2 image://page-1/9")], "doc string, text string")
    images = spark.createDataFrame([("d", 1, 2, 1, "first"), ("d", 1, 2, 2, "second")], "doc string, page int, index int, ord int, image string")
    assert [r.image for r in nested.resolve_images(texts, images).collect()] == ["first"]


def test_mathematics():
    assert mathematics.evaluate("2+3*4") == 14 and mathematics.evaluate("sqrt(x) + pi*0", {"x": 16}) == 4 and math.isclose(mathematics.evaluate("1/3"), 1 / 3)
    assert mathematics.solve("x**2-4=0") == [-2, 2] and mathematics.solve("2*t + 1 = t", "t") == [-1] and mathematics.solve("x^2+1") == [] and mathematics.solve("(x-1)^2") == [1]
    a, b = [[1, 2], [3, 4]], [[0, 1], [1, 0]]
    assert mathematics.matrix("mul", a, b) == [[2, 1], [4, 3]] and mathematics.matrix("det", a) == -2 and mathematics.matrix("inv", b) == b and mathematics.matrix("rank", a) == 2
    assert mathematics.matrix("add", a, b) == [[1, 3], [4, 4]] and mathematics.matrix("transpose", a) == [[1, 3], [2, 4]]
    for bad in ("", "__import__('os')", "x", "2**99999", "(1).real", "[1]"):
        with pytest.raises((ValueError, SyntaxError)):
            mathematics.evaluate(bad)
    with pytest.raises(ValueError):
        mathematics.solve("sqrt(x)")


# ---- Markdown
def test_markdown(spark):
    c = F.col("x")
    assert one(spark, markdown.bullet_line(c), x=" • item ") == "- item" and one(spark, markdown.bullet_line(c), x="plain  ") == "plain"
    assert one(spark, markdown.captions(c), x="Figure 1: one\ntext\nfigure 1 one\n图2 二\nFigure 1: one") == ["Figure 1: one", "图2 二"]
    assert one(spark, markdown.has_reference(c), x="see\nas in Fig. 3 here") and not one(spark, markdown.has_reference(c), x="nothing here")
    t = lambda p, x: one(spark, markdown.page_title(F.lit(p), c), x=x)
    assert (t(1, "a"), t(2, "Contents\nx"), t(3, "\nShort line\nb"), t(4, "y" * 61), t(5, "")) == ("封面", "目录", "Short line", "Page 4", "Page 5")
    strip = lambda x: one(spark, markdown.strip_edges(c, F.array(F.lit("Head")), F.array(F.lit("foot 1"))), x=x)
    assert strip("HEAD\n\nbody\nhead\nFoot 1\n") == "body\nhead" and strip("head\nfoot 1") == "" and strip("a\nb") == "a\nb" and strip("") == ""
    body = "text[^1]\n参考注释:\n- one\n[^1]: two\n\nafter\n[^2]: x\n[^2]: x"
    assert markdown.body_and_citations(body) == ("text[^1]\nafter", ["- one", "[^1]: two", "[^2]: x"])
    assert tuple(one(spark, markdown.split_citations(c), x=body)) == markdown.body_and_citations(body)
    assert markdown.inject_citations("word1 and 1 and word12", ["[^1]: note"]) == "word[^1] and 1 and word12"
    assert markdown.append_citations("a", ["[^1]: n", "[^1]: n"]) == "a\n\n[^1]: n" and markdown.footnote_numbers("x[^b] y[^a] z[^b]\n[^c]: d") == {"b": 1, "a": 2}
    page = "Aims\n• one\na\tb|c\nd\te\nFigure 1: shape\nend"
    want = "# Lost\n## Aims\n- one\n| a | b\\|c |\n| --- | --- |\n| d | e |\n![Figure 1: shape](image://page-3/1)\nFigure 1: shape\nend\n![image 2](image://page-3/2)"
    assert markdown.rendered(page, [("Lost", 1), ("AIMS", 2)], 3, 2, []) == want.replace("## Aims", "## AIMS")


# ---- phrases
def test_segments(spark):
    classes = [segmentation.token_class(x) for x in ("", " ", "\n<br>", "a", "-", "a-b", ",", "a!", "中")]
    assert classes == ["break", "exception", "exception", "content", "content", "content", "break", "break", "content"]
    noise = [segmentation.is_noise(x) for x in ("", "12", "1,000.5", "a", "中", "?!", "-", "ab", "--", "1a")]
    assert noise == [True, True, True, True, False, True, False, False, False, False]
    assert segmentation.filter_terms([" the", "New York", "x", "new york", "New York", "12", "fox"], 2) == ["New York", "new york"]
    tokens = ("new york is big , ".split() + ["the", "old", "town"]) * 12
    phrases, probs, owner = segmentation.positive_pmi(tokens, [0.1] * len(tokens))
    assert "newyork" in phrases[0] or phrases[0].startswith("newyork")
    assert len(owner) == len(tokens) and owner[tokens.index(",")] == -1 and max(owner) == len(phrases) - 1
    size = [owner.count(i) for i in range(len(phrases))]
    assert all(math.isclose(p, 0.1**n, rel_tol=1e-9) for p, n in zip(probs, size))
    few = segmentation.positive_pmi(tokens[:8], [0.1] * 8)
    assert few[0] == [t for t in tokens[:8] if t != ","]
    assert segmentation.transition_chain(["a", "b", "c", ",", "d"], [0.1, 0.9, 0.2, 1, 1]) == (["ab", "c", "d"], [0.09000000000000001, 0.2, 1.0], [0, 0, 1, -1, 2])
    assert segmentation.dictionary_words(["ab", "cd", "e"], [0.5, 0.5, 0.1], ["abc", "zz", "de"]) == (["abc", "zz", "de"], [0.25, 1e-300, 0.05], [0, 0, 2])
    assert segmentation.segmenter("none of this name") is segmentation.positive_pmi
    with pytest.raises(ValueError):
        segmentation.register(" ", segmentation.positive_pmi)
    t = spark.createDataFrame([(1, i, x, p) for i, (x, p) in enumerate([("a", -1), ("b", 2), ("c", -1), (",", -1), ("d", -1)])], "doc_id int, pos int, token string, phrase int")
    assert [r.phrase for r in segmentation.fill_phrases(t).orderBy("pos").collect()] == [2, 2, 2, 0, 0]
    two = [0.1] * 15 + [0.12] * 10 + [0.8] * 12 + [0.82] * 9
    low, high = one(spark, segmentation.valley_thresholds(F.array(*[F.lit(x) for x in two])), x=1)
    assert 0.1 < low < 0.8 and low <= high
    assert tuple(one(spark, segmentation.valley_thresholds(F.array(F.lit(0.5))), x=1)) == (0.2, 0.6)


def test_pages_are_cut_at_their_outline_alone(spark, tmp_path):
    """A heading past the first lines of its page, and body lines that begin with numbers."""
    from tessella.plans import ORACLE_SQL, QUERIES

    long = "\n".join(f"line number {i} of the text" for i in range(600))
    rows = [(1, long), (2, "\n".join(["56.187.231.175 Keit"] * 12)), (3, "121953 Words."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["page_fragments"](spark, str(tmp_path))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLE_SQL['page_fragments']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
