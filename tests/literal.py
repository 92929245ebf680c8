"""Small literal tables for shapes that the fixture tables lack; the same rows as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARKERS = [
    ("a", 1, "Part one", 1, 1), ("a", 2, "1.1 Aims .... 3", 3, 2), ("a", 3, "1.1.1 Scope", 4, 3), ("a", 4, "Unplaced", None, 2),
    ("a", 5, "1.2 Means", 6, 2), ("a", 6, "Part two", 9, 1), ("a", 7, "Same page", 9, 2), ("a", 8, "2.1 Ends", 9, 2), ("a", 9, "", 10, 2),
    ("b", 1, "# Start", 2, 2), ("b", 2, "Deep", 2, 4), ("b", 3, "Next", 5, 2), ("b", 4, "Top", 7, 1), ("b", 5, "Zero", 0, 1),
    *[("d", i, f"Level {i}", i, i) for i in range(1, 11)], ("d", 11, "Back", 11, 4), ("d", 12, "Down", 12, 9),
    ("c", 1, "One", 1, 1), ("c", 2, "Two", 2, 1), ("c", 3, "Three", 5, 1), ("c", 4, "Four", 7, 1), ("c", 5, "Five", 8, 1),
]
HEADINGS = [("a", 2, "part ONE"), ("a", 5, "1.2 means"), ("a", 7, "1.2 Means!"), ("a", 10, "Part two"), ("a", 4, "Part two"), ("c", 1, "One"), ("c", 3, "Two."), ("b", 6, "Next")]
ANCHORS = [("a", 2, 3), ("a", 6, 12), ("a", 9, 13), ("b", 1, 4)]
PAGES = [(d, p) for d in "abc" for p in range(1, 13)]
SECTIONS = [("a", 1, "x/y"), ("a", 2, "x/y"), ("a", 3, "x/z"), ("a", 5, "x"), ("a", 6, "x/y"), ("a", 7, ""), ("b", 1, "q"), ("b", 2, "r"), ("b", 3, "r")]
SECTIONS_2 = [("a", 1, "x/y"), ("a", 2, "x/z"), ("a", 3, "x/z"), ("a", 5, "x"), ("a", 6, "x"), ("b", 1, "q"), ("b", 2, "r"), ("b", 3, "s"), ("b", 4, "s")]
TEXTS = [("a", o, p, t) for o, p, t in [(3, 4, "scope"), (5, 6, "means"), (7, 9, " "), (8, 9, "ends"), (1, 1, "not a leaf"), (4, 5, "unplaced")]] + [("b", 2, 2, "deep"), ("b", 3, 5, "next"), ("d", 10, 10, "deepest"), ("d", 12, 12, "down")]
NUMERALS = ["IV", "MIX", "IIII", "iv", "一百零五", "十二", "三千零一", "二万五", "-3", "2.7", "", " ", "p. 12", "abc", "0", "XIX", "12", "第七", "１"]
LINES = [
    "# Title", "### Deep one", "Chapter IV of it", "section 3", "1.2 Aims", "1.2.3Aims v1.0", "3 Plan v2.0", "第三章 绪论", "附录A", "前言 x", "Contents", "plain words", "",
    "Aims .... 12", "Aims | 7 |", "The mix", "page 12", "p.7", "第 9 页", " 44 ", "6001", "xiv", "Step 5", "图 1 示意", "| Aims   3 |", "#NoBlank",
]
CALLS = [("s1", i, f"t{i % 3}", ["", "a", "a>b", "ab", "a>b>c"][i % 5], i % 4 != 3) for i in range(20)]
URLS = ["http://www.a.com:80/x?y=1", "a.com", "10.0.0.1/z", "HTTPS://B.org", "not a url", "", "ftp://c.net/q", "localhost", "x-y.co.uk/p"]


def _sql(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({names})"


#: name: (rows, schema)
TABLES = {
    "markers": (MARKERS, "doc string, ord int, title string, page int, level int"),
    "headings": (HEADINGS, "doc string, page int, text string"),
    "anchors": (ANCHORS, "doc string, src int, dst int"),
    "pages": (PAGES, "doc string, page int"),
    "sections": (SECTIONS, "doc string, page int, path string"),
    "sections_2": (SECTIONS_2, "doc string, page int, path string"),
    "texts": (TEXTS, "doc string, ord int, page int, text string"),
    "numerals": ([(i, x) for i, x in enumerate(NUMERALS)], "id int, token string"),
    "lines": ([(i, x) for i, x in enumerate(LINES)], "id int, line string"),
    "calls": (CALLS, "session string, ord int, tool string, scope string, ended boolean"),
    "urls": ([(i, x) for i, x in enumerate(URLS)], "id int, url string"),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    rows, schema = TABLES[name]
    return spark.createDataFrame(rows, schema)


def sql(name: str) -> str:
    rows, schema = TABLES[name]
    return "(SELECT * FROM " + _sql(rows, ", ".join(c.split()[0] for c in schema.split(", "))) + ")"
