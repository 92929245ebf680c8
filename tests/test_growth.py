"""Steps that must not grow faster than the tables: what is shuffled, held and written."""

from tessella.operators import keywords, segmentation

TEXTS = [(i, f"alpha beta gamma delta word{i} alpha" if i % 3 else f"beta other{i % 4} über x2 ...") for i in range(30)] + [(30, None), (31, "of the")]


def plan(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.split("Initial Plan")[-1]


def test_terms_are_ranked_in_blocks_without_joins(spark, monkeypatch, capsys):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    by_rows = sorted(map(tuple, keywords.ranked_terms(keywords.term_counts(docs), 3).collect()))
    assert sorted(map(tuple, keywords.tfidf(docs, 3).collect())) == by_rows
    monkeypatch.setattr(keywords, "BLOCK_CHARS", 50)
    got = keywords.tfidf(docs, 3)
    assert sorted(map(tuple, got.collect())) == by_rows
    assert "Join" not in plan(got, capsys)


def test_tokens_get_their_shares_in_blocks(spark, monkeypatch, capsys):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = lambda: sorted((r.doc_id, tuple(r.tokens), tuple(r.probabilities)) for r in segmentation.corpus_tokens(docs).collect())
    whole = rows()
    assert {i: "".join(t) for i, t, _ in whole} == {i: t for i, t in TEXTS if t}
    monkeypatch.setattr(keywords, "BLOCK_CHARS", 50)
    assert rows() == whole
    text = plan(segmentation.corpus_tokens(docs), capsys)
    assert "Join" not in text and "collect_list" not in text and "Scan ExistingRDD[row" not in text


def test_noise_is_counted_without_exploded_words(spark, tmp_path, capsys):
    from tessella.plans import QUERIES

    rows = [(1, "a 12 word 1_2 __ 图 图画 x"), (2, "..."), (3, None), (4, "word")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["noise_terms"](spark, str(tmp_path))
    assert {r.doc_id: r.noise for r in got.collect()} == {1: 5, 4: 0}
    assert "Generate" not in plan(got, capsys)


def test_assets_reach_their_ancestors_in_one_sorted_pass(spark, capsys):
    from tessella.operators import trees

    nodes = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 3, 2), ("a", 4, 1)], "doc string, at int, level int")
    rows = [("a", 2, "headers", 1, "y"), ("a", 2, "headers", 0, " x "), ("a", 3, "headers", 0, "x"), ("a", 3, "images", 0, "p"), ("a", 4, "headers", 0, " "), ("a", 9, "headers", 0, "z")]
    got = trees.subtree_assets(nodes, spark.createDataFrame(rows, "doc string, at int, list string, pos int, value string"))
    assert {r["at"]: (r.headers, r.images) for r in got.collect()} == {1: (["x", "y"], ["p"]), 2: (["x", "y"], []), 3: (["x"], ["p"])}
    assert plan(got, capsys).count("Exchange") == 1


def test_runs_of_sections_are_one_sorted_pass(spark, capsys):
    from tessella.operators import catalog

    rows = [("a", 1, "x/y"), ("a", 2, "x/z"), ("a", 2, "x/z"), ("a", 4, "x/y"), ("a", 3, ""), ("b", 5, "x")]
    got = catalog.section_runs(spark.createDataFrame(rows, "doc string, page int, path string"))
    want = [("a", "x", 1, 1, 2), ("a", "x", 1, 4, 4), ("a", "x/y", 2, 1, 1), ("a", "x/y", 2, 4, 4), ("a", "x/z", 2, 2, 2), ("b", "x", 1, 5, 5)]
    assert sorted(map(tuple, got.collect())) == want
    text = plan(got, capsys)
    assert text.count("Exchange") == 1 and "Window" not in text and "HashAggregate" not in text


def test_pages_are_projected_in_one_sorted_pass(spark, capsys):
    from tessella.operators import catalog

    pages = spark.createDataFrame([("a", p) for p in range(1, 9)] + [("b", 3)], "doc string, page int")
    anchors = spark.createDataFrame([("a", 2, 4), ("a", 5, 5)], "doc string, src int, dst int")
    got = catalog.project_pages(pages, anchors, 7)
    assert [tuple(r) for r in got.orderBy("doc", "page").collect()] == [("a", p, m) for p, m in zip(range(1, 9), (3, 4, 4, 5, 5, 6, 7, 7))] + [("b", 3, 3)]
    text = plan(got, capsys)
    assert text.count("Sort ") == 1 and "Window" not in text


def test_lines_of_words_are_made_page_by_page(spark, tmp_path, capsys):
    from tessella.plans import QUERIES

    spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(85))), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["word_lines"](spark, str(tmp_path))
    assert sorted((r.doc_id, r.page, r["at"]) for r in got.collect()) == [(1, p, a) for p, n in ((0, 5), (1, 5), (2, 1)) for a in range(1, n + 1)]
    assert "Exchange" not in plan(got, capsys)


def test_probing_in_small_blocks_is_exact(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tessella.operators import vectors

    e = spark.createDataFrame([(i, [float(i % 7), float(i * i % 11), float(i // 40)]) for i in range(120)], "vec_id long, embedding array<float>")
    cells, centres = vectors.clustered(e, 9)
    queries = e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    rows = {r.vec_id: r.embedding for r in e.collect()}
    far = lambda a, b: round(sum((x - y) ** 2 for x, y in zip(rows[a], rows[b])), 6)
    want = sorted((q, v, d) for q in rows if q % 10 == 0 for d, v in sorted((far(q, v), v) for v in rows)[:5])
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 5)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 4)
    assert sorted(map(tuple, vectors.probe(cells, centres, queries, 5).collect())) == want


def test_rare_pairs_are_not_kept(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha beta word{i} gamma") for i in range(12)], "doc_id long, text string")
    whole = sorted(map(tuple, keywords.neighbour_pmi(docs, 10).collect()))
    assert [r[:3] for r in whole] == [("alpha", "beta", 12)]
    kept, cut = [], keywords.cut_lineage
    monkeypatch.setattr(keywords, "HELD_PAIRS", 3)
    monkeypatch.setattr(keywords, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    assert sorted(map(tuple, keywords.neighbour_pmi(docs, 10).collect())) == whole
    assert kept[0].where("left is not null and right is not null").count() == 1


def test_pairs_are_summed_in_buckets_without_a_row_each(spark, monkeypatch, capsys):
    from collections import Counter

    texts = [f"_alpha- beta w{i % 4}x 图画 图 _-_ the K\u212a\u212a" for i in range(24)] + ["beta", "", None, "alpha beta " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lists = [keywords._terms(t) for t in texts]
    one, two = Counter(x for t in lists for x in t), Counter(p for t in lists for p in zip(t, t[1:]))
    want = {(a, None): n for a, n in one.items()} | {p: n for p, n in two.items() if n >= 10} | {(None, None): two.total()}
    kept, cut = [], keywords.cut_lineage
    monkeypatch.setattr(keywords, "cut_lineage", lambda df: kept.append(df) or cut(df))
    whole = sorted(map(tuple, keywords.neighbour_pmi(docs, 10).collect()))
    monkeypatch.setattr(keywords, "HELD_PAIRS", 3)
    monkeypatch.setattr(keywords, "BUCKET_CHARS", 40)
    assert whole and sorted(map(tuple, keywords.neighbour_pmi(docs, 10).collect())) == whole
    assert [{(r.left, r.right): r.n for r in df.collect()} for df in kept] == [want, want]
    assert "HashAggregate" not in plan(kept[1], capsys)


def test_batches_of_texts_are_small(spark):
    from pyspark.sql import functions as F

    from tessella.functions import markdown
    from tessella.operators import chunking

    docs = spark.createDataFrame([(i, f"word{i} " * 400) for i in range(40)], "doc_id long, text string")
    none = F.array().cast("array<string>")
    makers = {
        "chunks": lambda: chunking.chunks(docs), "term_counts": lambda: keywords.term_counts(docs),
        "render": lambda: docs.select(markdown.render(F.col("text"), F.array().cast("array<struct<title:string,level:int>>"), F.lit(1), F.lit(0), none)),
    }
    for name, make in makers.items():
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        make()
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000", name


def test_what_a_worker_holds_is_handed_on(spark, monkeypatch):
    from tessella.operators import chunking

    docs = spark.createDataFrame([(i, f"word{i} other " * 300) for i in range(20)], "doc_id long, text string")
    sides = lambda: (sorted(map(tuple, chunking.chunks(docs).collect())), sorted(tuple(r)[1:] for r in keywords.term_counts(docs).collect()))
    whole = sides()
    monkeypatch.setattr(chunking, "HELD_PIECES", 2)
    monkeypatch.setattr(keywords, "HELD_ROWS", 3)
    assert sides() == whole


def test_only_pages_with_markers_are_cut_into_lines(spark, monkeypatch):
    from tessella.operators import trees

    pages = spark.createDataFrame([("a", 1, "One\ntext"), ("a", 2, " other\nOne "), ("b", 1, None), (None, 1, "One")], "doc string, page int, text string")
    markers = spark.createDataFrame([("a", 1, "One", 1, 1), ("c", 1, "One", 1, 1), (None, 1, "One", 1, 1)], "doc string, ord int, title string, page int, level int")
    asked, inner = [], trees.lines
    monkeypatch.setattr(trees, "lines", lambda p: asked.append(p) or inner(p))
    got = {(r.doc, r.page): (r.fragment, r["count"], r.title, r.path, r.text) for r in trees.split_pages(pages, markers).collect()}
    assert got == {("a", 1): (1, 1, "One", "One", "One\ntext"), ("a", 2): (1, 1, "", "", "other\nOne"), ("b", 1): (1, 1, "", "", ""), (None, 1): (1, 1, "", "", "One")}
    assert [p.count() for p in asked] == [1]


def test_ingested_documents_are_dealt_evenly(spark, tmp_path, monkeypatch, capsys):
    from tessella.operators import builders, ingest

    kept, cut = [], builders.cut_lineage
    monkeypatch.setattr(builders, "cut_lineage", lambda df: kept.append(df) or cut(df))
    docs = spark.createDataFrame([(i, f"doc {i}.txt", f"word{i} " * 50) for i in range(40)], "doc_id long, doc_name string, text string").coalesce(1)
    builders.ingest(ingest.Store(spark, f"file://{tmp_path}/store"), docs)
    assert kept[0].columns == ["doc_id", "doc_name", "text"] and "hashpartitioning(doc_id" in plan(kept[0], capsys)
    # what stands around a page is made once: it is kept before notes are carried on, which reads it twice
    assert [df.columns for df in kept if "notes" in df.columns][0] == [df.columns for df in kept if "notes" in df.columns][1]


def test_phrases_that_cannot_merge_make_no_units(monkeypatch):
    tokens = ["ab", " ", "cd", ",", "ef", "\n", "ab", "cd"] * 3
    p = [0.5, 0.1, 0.25, 0.2, 0.125, 0.1, 0.5, 0.25] * 3
    asked, inner = [], segmentation._class
    monkeypatch.setattr(segmentation, "_known_class", segmentation.lru_cache(9)(lambda t: asked.append(t) or inner(t)))
    want = [(t, q) for t, q in zip(tokens, p) if t not in " ,\n"]
    once = segmentation.positive_pmi(tokens, p, 3)  # ab cd come 6 times, and are merged
    assert [x for x in once[0] if len(x) > 2] and sorted(asked) == sorted(set(tokens))
    monkeypatch.setattr(segmentation, "_Unit", None)
    phrases, probs, owner = segmentation.positive_pmi(tokens, p, 10)
    assert phrases == [t for t, _ in want] and [round(x, 9) for x in probs] == [q for _, q in want]
    assert [i for i in owner if i >= 0] == list(range(len(want))) and owner.count(-1) == 9
