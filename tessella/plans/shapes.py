"""Shapes that the given tables lack, made from whole given tables: outlines, pages, headings, scopes, numerals; as DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROMAN_PLACES = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]]
CN = "一二三四五六七八九"


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order and line: doc, ord, k (part), s (supplier), q (quantity), f and g (flags)."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("int").alias("ord"))
    return rows.agg(F.min("l_partkey").alias("k"), F.min("l_suppkey").alias("s"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("g"))


def _text(c: Column) -> Column:
    return c.cast("string")


def _markers(rows: DataFrame) -> DataFrame:
    k = F.col("k")
    level = (1 + F.col("s") % 7).cast("int")
    part = F.concat(F.lit("Part "), _text(k % 97))
    title = F.when(k % 11 == 0, "").when(k % 5 == 0, F.concat(F.lit("# "), part)).otherwise(F.concat(_text(F.col("ord")), F.lit("."), _text(level), F.lit(" "), part))
    page = F.when(k % 13 == 0, F.lit(None)).when(k % 17 == 0, F.lit(0)).otherwise(F.col("ord") * 2 - 1 + F.col("q") % 3).cast("int")
    return rows.select("doc", "ord", title.alias("title"), page.alias("page"), level.alias("level"))


_LINES = "(SELECT l_orderkey AS doc, l_linenumber::INT AS ord, min(l_partkey) AS k, min(l_suppkey) AS s, min(l_quantity)::INT AS q, min(l_returnflag) AS f, min(l_linestatus) AS g FROM lineitem GROUP BY 1, 2)"
_MARKERS = (
    "(SELECT doc, ord, CASE WHEN k % 11 = 0 THEN '' WHEN k % 5 = 0 THEN '# Part ' || (k % 97) ELSE ord || '.' || (1 + s % 7) || ' Part ' || (k % 97) END AS title, "
    f"CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 0 ELSE ord * 2 - 1 + q % 3 END::INT AS page, (1 + s % 7)::INT AS level FROM {_LINES})"
)


def _headings(spark, sf_dir):
    m = frame(spark, sf_dir, "markers").where((F.col("doc") + F.col("ord")) % 3 > 0)
    return m.select("doc", (F.coalesce("page", F.lit(1)) + F.col("ord") % 2).cast("int").alias("page"), F.concat(F.upper("title"), F.lit("!")).alias("text"))


def _pages(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc")).distinct()
    return d.select("doc", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page"))


def _anchors(spark, sf_dir):
    m = frame(spark, sf_dir, "markers").where("page > 0 and ord % 2 = 0")
    return m.groupBy("doc", F.col("page").alias("src")).agg(F.min(F.col("page") + F.col("ord")).cast("int").alias("dst"))


def _sections(spark, sf_dir):
    r = _lineitem(spark, sf_dir)
    path = F.when(F.col("k") % 10 == 0, "").otherwise(F.concat_ws("/", "f", "g", F.when(F.col("k") % 2 == 0, _text(F.col("s") % 2))))
    return r.select("doc", F.col("ord").alias("page"), path.alias("path"))


def _sections_2(spark, sf_dir):
    r = _lineitem(spark, sf_dir).where("ord <> 3")
    return r.select("doc", F.col("ord").alias("page"), F.when(F.col("q") % 4 == 0, F.col("f")).otherwise(F.concat_ws("/", "f", "g")).alias("path"))


def _texts(spark, sf_dir):
    m = frame(spark, sf_dir, "markers").where("ord % 4 <> 1")
    return m.select("doc", "ord", F.coalesce("page", F.lit(1)).alias("page"), F.when(F.col("ord") % 3 == 0, " ").otherwise(F.col("title")).alias("text"))


def roman(n: Column) -> Column:
    """n below 4000 in Roman digits."""
    place = lambda i: F.element_at(F.array(*[F.lit(x) for x in ROMAN_PLACES[i]]), (F.floor(n / 10**i) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(2), place(1), place(0))


def chinese(n: Column) -> Column:
    """n below 10000 in Chinese digits and units."""
    d = lambda u: (F.floor(n / u) % 10).cast("int")
    sign = lambda u, s: F.when(d(u) > 0, F.concat(F.substring(F.lit(CN), d(u), F.lit(1)), F.lit(s)))
    empty = lambda c: F.coalesce(c, F.lit(""))
    gap = lambda above, below: F.when(above & (below > 0), "零")
    return F.concat(
        empty(sign(1000, "千")), empty(F.coalesce(sign(100, "百"), gap(d(1000) > 0, n % 100))),
        empty(F.coalesce(sign(10, "十"), gap(d(100) > 0, n % 10))), empty(sign(1, "")),
    )


def _numerals(spark, sf_dir):
    n = (F.col("p_partkey") % 10000).cast("int")
    token = F.element_at(F.array(roman(n), chinese(n), F.concat(F.lit("p. "), _text(n)), F.concat(F.lit("-"), _text(n)), F.concat(_text(n), F.lit(".7"))), (n % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", n.alias("n"), token.alias("token"))


_PLACE = lambda i: "[" + ", ".join(f"'{x}'" for x in ROMAN_PLACES[i]) + f"][n // {10**i} % 10 + 1]"
_ROMAN = f"repeat('M', (n // 1000)::INT) || {_PLACE(2)} || {_PLACE(1)} || {_PLACE(0)}"


def _hints(spark, sf_dir):
    n = F.col("p_partkey").cast("int")
    forms = [F.concat(F.lit("Page "), _text(n)), F.concat(F.lit("p."), _text(n)), F.concat(F.lit("第 "), _text(n), F.lit(" 页")), F.concat(F.lit(" "), _text(n), F.lit(" ")), F.concat(F.lit("see "), _text(n))]
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.element_at(F.array(*forms), (n % 5 + 1).cast("int")).alias("line"))


def _calls(spark, sf_dir):
    e = F.col("event_id")
    scope = F.element_at(F.array(*[F.lit(x) for x in ("", "a", "a>b", "ab", "a>b>c")]), (e % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session"), e.alias("ord"), F.col("event_type").alias("tool"), scope.alias("scope"), (F.col("value") >= 20).alias("ended"))


def _urls(spark, sf_dir):
    i, u = F.col("page_id"), F.col("url")
    forms = [u, F.regexp_replace(u, "^https?://", ""), F.concat(F.lit("  "), u, F.lit(" ")), F.concat(F.lit("not a url "), _text(i)), F.concat(F.lit("HTTP"), F.expr("substring(url, 5)")), F.concat(F.lit("ftp://h/"), _text(i)), F.concat(F.lit("10.0.0."), _text(i % 256), F.lit(":80/x"))]
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.element_at(F.array(*forms), (i % 7 + 1).cast("int")).alias("url"))


#: name: (DataFrame of a session and a folder, SQL)
SHAPES = {
    "markers": (lambda spark, sf_dir: _markers(_lineitem(spark, sf_dir)), _MARKERS),
    "headings": (_headings, f"(SELECT doc, (coalesce(page, 1) + ord % 2)::INT AS page, upper(title) || '!' AS text FROM {_MARKERS} WHERE (doc + ord) % 3 > 0)"),
    "pages": (_pages, "(SELECT doc, p::INT AS page FROM (SELECT DISTINCT l_orderkey AS doc FROM lineitem), (SELECT unnest(range(1, 13)) AS p))"),
    "anchors": (_anchors, f"(SELECT doc, page AS src, min(page + ord)::INT AS dst FROM {_MARKERS} WHERE page > 0 AND ord % 2 = 0 GROUP BY 1, 2)"),
    "sections": (_sections, f"(SELECT doc, ord AS page, CASE WHEN k % 10 = 0 THEN '' ELSE f || '/' || g || CASE WHEN k % 2 = 0 THEN '/' || (s % 2) ELSE '' END END AS path FROM {_LINES})"),
    "sections_2": (_sections_2, f"(SELECT doc, ord AS page, CASE WHEN q % 4 = 0 THEN f ELSE f || '/' || g END AS path FROM {_LINES} WHERE ord <> 3)"),
    "texts": (_texts, f"(SELECT doc, ord, coalesce(page, 1) AS page, CASE WHEN ord % 3 = 0 THEN ' ' ELSE title END AS text FROM {_MARKERS} WHERE ord % 4 <> 1)"),
    "numerals": (_numerals, f"(SELECT p_partkey, n, n % 5 AS form, CASE n % 5 WHEN 0 THEN {_ROMAN} ELSE '' END AS roman FROM (SELECT p_partkey, (p_partkey % 10000)::INT AS n FROM part))"),
    "hints": (_hints, "part"),
    "calls": (_calls, "(SELECT user_id AS session, event_id AS ord, event_type AS tool, ['', 'a', 'a>b', 'ab', 'a>b>c'][event_id % 5 + 1] AS scope, value >= 20 AS ended FROM events)"),
    "urls": (_urls, "pages"),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return SHAPES[name][0](spark, sf_dir)


def sql(name: str) -> str:
    return SHAPES[name][1]
