"""Rare shapes as literal cases: numerals, heading lines, page hints."""

from pyspark.sql import functions as F

from tessella.functions import text, web
from tests import literal

NUMERALS = [
    (4, None, 4), (1009, None, 1009), (4, None, 4), (4, None, 4), (None, 105, None), (None, 12, None), (None, 3001, None), (None, 20005, None), (None, None, 0), (None, None, 2),
    (None, None, None), (None, None, None), (None, None, 12), (None, None, None), (None, 0, 0), (19, None, 19), (None, 12, 12), (None, None, None), (None, None, None),
]
LEVELS = {0: 1, 1: 3, 2: 1, 3: 1, 4: 2, 5: 3, 6: 2, 7: 1, 8: 1, 9: 2}
HINTS = {16: 12, 17: 7, 18: 9, 19: 44, 21: 14, 22: 5}


def test_numerals(spark):
    t = F.col("token")
    rows = literal.frame(spark, "numerals").select("id", text.roman_to_int(t), text.chinese_to_int(t), text.coerce_page(t)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in rows] == NUMERALS


def test_lines(spark):
    c = F.col("line")
    for r in literal.frame(spark, "lines").select("id", text.heading_level(c).alias("level"), text.page_hint(c).alias("hint")).collect():
        assert (r.level, r.hint) == (LEVELS.get(r.id), HINTS.get(r.id))


def test_urls(spark):
    got = [r[1] for r in literal.frame(spark, "urls").select("id", web.normalise_url(F.col("url"))).orderBy("id").collect()]
    assert got == ["http://www.a.com:80/x?y=1", "https://a.com", "https://10.0.0.1/z", "HTTPS://B.org", "not a url", "", "ftp://c.net/q", "localhost", "https://x-y.co.uk/p"]


def test_longer_numbers_are_no_pages(spark):
    lines = spark.createDataFrame([("Page 10000",), ("p. 20001",), ("Page 5000",), ("MMMMM",), ("MMMCM",)], "line string")
    got = lines.select(text.page_hint(F.col("line")), text.roman_to_int(F.col("line")), text.coerce_page(F.col("line"))).collect()
    assert [tuple(r) for r in got] == [(None, None, 10000), (None, None, 20001), (5000, None, 5000), (None, None, None), (3900, 3900, 3900)]
