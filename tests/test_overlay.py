import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import alignment, catalog, overlay


def spans(n, rng, pages=40):
    rows = []
    for i in range(n):
        a = rng.randrange(1, pages)
        rows.append((rng.choice("abc"), i, a, a + rng.choice([0, 0, 1, 3, 30, -1]), rng.randrange(1, 5)))
    return rows


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_best_range_equals_search(spark, monkeypatch, block):
    monkeypatch.setattr(overlay, "BLOCK", block)
    rows = spans(150, random.Random(3))
    ranges = spark.createDataFrame(rows, "doc string, ord int, start int, end int, level int")
    pages = spark.createDataFrame([(d, p) for d in "abcz" for p in range(45)] + [(None, 3)], "doc string, page int")
    got = {(r.doc, r.page): r.ord for r in overlay.cover(pages, ranges).collect()}
    for (d, p), o in got.items():
        held = [(-lv, e - s, s, i) for x, i, s, e, lv in rows if x == d and s <= p <= e]
        assert o == (min(held)[-1] if held else None)
    assert len(got) == 181
    plan = overlay.cover(pages, ranges)._jdf.queryExecution().toString()
    assert "Join" not in plan
    best = catalog.best_section(pages, ranges)
    assert best.count() == sum(o is not None for o in got.values()) and set(best.columns) == {"doc", "page", "ord", "start", "end", "level"}


def test_extent_equals_search(spark):
    rng = random.Random(4)
    rows = [r[:4] for r in spans(120, rng)]
    points = [(rng.choice("abc"), rng.randrange(45), rng.choice([None, *range(20)])) for _ in range(70)]
    got = {(r.doc, r.ord): (r.least, r.greatest) for r in overlay.extent(spark.createDataFrame(rows, "doc string, ord int, start int, end int"), spark.createDataFrame(points, "doc string, at int, value int")).collect()}
    want = {}
    for d, i, s, e in rows:
        values = [v for x, at, v in points if x == d and s <= at <= e and v is not None]
        if values:
            want[d, i] = (min(values), max(values))
    assert got == want


def test_open_rows(spark):
    rng = random.Random(5)
    rows = [(d, i, rng.randrange(1, 9), rng.choice([None, i * 10, i * 10])) for d in ("x", "y", None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc string, ord int, level int, page int").repartition(3)
    got = {(r.doc, r.ord): r.open for r in overlay.open_rows(df, F.col("ord"), "ord").collect()}
    own = lambda d: [r for r in rows if r[0] == d]
    for d, o, lv, _ in rows:
        want, least = [], lv
        for _, p, k, _ in reversed([r for r in own(d) if r[1] < o]):
            if k < least:
                want.insert(0, p)
                least = k
        assert got[d, o] == want
    back = {(r.doc, r.ord): (r.open or [None])[-1] for r in overlay.open_rows(df, -F.col("ord"), "page", strict=False, counts=F.col("page").isNotNull()).collect()}
    for d, o, lv, _ in rows:
        assert back[d, o] == next((pg for _, p, k, pg in own(d) if p > o and k <= lv and pg is not None), None)


def test_circles_are_found(spark):
    edges = spark.createDataFrame([("d", 1, None), ("d", 2, 3), ("d", 3, 2), ("e", 1, None), ("e", 2, 1)], "doc string, ord int, parent int")
    with pytest.raises(ValueError, match="'d'"):
        catalog.closure(edges)
    assert catalog.closure(edges.where("doc = 'e'")).count() == 3
    chain = spark.createDataFrame([("c", i, i - 1 or None) for i in range(1, 34)], edges.schema)
    assert catalog.closure(chain).count() == 33 * 34 // 2


def walked(source, target):
    """Both lists at once, a page on either side at a time."""
    out, s, t, met = {}, 0, 0, 0
    after = lambda x, i: x[i + 1] if i + 1 < len(x) else ""
    while s < len(source) and t < len(target):
        here = alignment.same_page(source[s], target[t])
        if not target[t] or (source[s] and not here and alignment.same_page(source[s], after(target, t))):
            t += 1
            continue
        if source[s] and not here and alignment.same_page(after(source, s), target[t]):
            s += 1
            continue
        out[s + 1] = t + 1
        met += here
        t += bool(source[s])
        s += 1
    return out, met


def test_alignment_of_random_lists():
    rng = random.Random(6)
    for _ in range(3000):
        a, b = ([rng.choice(["", "p", "q", "r|x", "r|y", "introduction|z", "theintroductionis|w"]) for _ in range(rng.randrange(7))] for _ in range(2))
        out, met = walked(a, b)
        got = alignment.align(a, b)
        assert {k: v for k, v in got.items() if k in out} == (out if met else {}) and (not met or len(got) == len(a))


DIGITS = "零一二三四五六七八九"


def chinese(n):
    if n >= 10000:
        rest = chinese(n % 10000) if n % 10000 else ""
        return chinese(n // 10000) + "万" + (("零" if n % 10000 < 1000 else "") + rest if rest else "")
    out = ""
    for unit, sign in ((1000, "千"), (100, "百"), (10, "十"), (1, "")):
        d = n // unit % 10
        if d:
            out += DIGITS[d] + sign
        elif out and not out.endswith("零") and n % unit:
            out += "零"
    return out


def test_chinese_numerals(spark):
    rng = random.Random(7)
    numbers = [*range(1, 300), *(rng.randrange(1, 10**8) for _ in range(300))]
    rows = [(chinese(n), n) for n in numbers] + [("十二", 12), ("百", 100), ("两千", 2000), ("万", None), ("零", None), ("一二", 2), ("零十", 10), ("", None), ("12", 12), ("第七", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, n long").withColumn("v", text.chinese_to_int(F.col("t"))).collect()
    assert [(r.t, r.v) for r in got] == [(r.t, r.n) for r in got]


def test_best_section_broadcasts_nothing(spark, capsys):
    """Pages exploded from few rows look small to the planner."""
    pages = spark.range(10).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page"))
    ranges = spark.createDataFrame([(1, 1, 2, 3, 1)], "doc long, ord int, start int, end int, level int")
    best = catalog.best_section(pages, ranges)
    assert sorted(r.page for r in best.collect()) == [2, 3]
    best.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_lines_of_equal_rows_do_not_depend_on_their_order(spark):
    rows = [(1, o, "Part", 3, 3, 2) for o in range(8)] + [(1, 8, "End", 4, 4, 1)]
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "doc int, ord int, title string, page int, end int, level int")
        got = {r.ord: r.line for r in catalog.catalog_lines(df).collect()}
        assert [o for o in range(8) if "└─" in got[o]] == [7]
