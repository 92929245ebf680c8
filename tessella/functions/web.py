"""HTML and URL functions as column expressions."""

from __future__ import annotations

import html
import re
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessella.functions.text import strip


def strip_tags(c: Column) -> Column:
    """Without tags that open and close on one line, and without outer space; entities stay."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "<.*?>", ""))


def unescape(c: Column) -> Column:
    """Entities resolved; Spark has no function for them, so this is an Arrow function."""

    @pandas_udf("string")
    def resolve(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else html.unescape(x))

    return resolve(c)


def domain(c: Column) -> Column:
    """Host of a URL in small letters, without port and leading www."""
    host = F.regexp_extract(F.lower(strip(F.coalesce(c, F.lit("")))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(host, ":.*$", ""), r"^www\.", "")


def normalise_url(c: Column) -> Column:
    """http(s) URLs as they are; a bare host or address gets https; anything else stays."""
    t = strip(F.coalesce(c, F.lit("")))
    bare = t.rlike(r"(?i)^([a-z0-9-]+\.)+[a-z]{2,}(:\d+)?([/?#].*)?$") | t.rlike(r"^(\d{1,3}\.){3}\d{1,3}(:\d+)?([/?#].*)?$")
    return F.when(t.rlike("(?i)^https?://"), t).when(bare, F.concat(F.lit("https://"), t)).otherwise(t)


def direct_url(c: Column, marked: Column) -> Column:
    """struct(url, direct): the normalised URL, and whether it came as such: it is one, and isn't marked as a reference's result.

    marked: how many marks the normalised URL has (see mark_counts); null for none.
    """
    url = normalise_url(c)
    direct = url.rlike("(?i)^https?://") & (F.coalesce(marked, F.lit(0)) <= 0)
    return F.struct(url.alias("url"), direct.alias("direct"))


def set_query_parameter(c: Column, key: str, value: str) -> Column:
    """The URL with each `key` of its query set to value, or with the pair added."""

    @pandas_udf("string")
    def put(urls: pd.Series) -> pd.Series:
        def one(url):
            if url is None:
                return None
            u = urlsplit(url)
            pairs = parse_qsl(u.query, keep_blank_values=True)
            known = any(k == key for k, _ in pairs)
            pairs = [(k, value if k == key else v) for k, v in pairs] + ([] if known else [(key, value)])
            return urlunsplit(u._replace(query=urlencode(pairs)))

        return urls.map(one)

    return put(c)


def masked_link(url: Column, call: Column, result: Column) -> Column:
    """The domain and a reference to result number `result` of call number `call`."""
    ref = F.format_string("search_web[%d][%d].link", call.cast("int"), result.cast("int"))
    return F.concat(domain(url), F.lit(" | "), ref)


def plain_text(c: Column) -> Column:
    """Without tags, with entities resolved, without outer space."""
    return strip(unescape(strip_tags(c)))


def records(pages: DataFrame, pattern: str, html: str = "html", top_k: int = 10, most: int | None = None) -> DataFrame:
    """pages' columns but the html, and at, link, title, snippet: what a pattern with named groups finds, http links first come only.

    pattern: groups `link` (mandatory), `title`, `snippet`, matched over lines and without case. The
    title defaults to the link; a link counts once in a page, and a page gives top_k at most (a top-k report).
    most: read so many characters of each page (a limit of the caller's; none as a rule).
    """
    names = re.findall(r"\(\?P<(\w+)>", pattern)
    if "link" not in names:
        raise ValueError("the pattern needs a group named link")
    java = F.lit("(?is)" + pattern.replace("(?P<", "(?<"))
    text = F.col(html) if most is None else F.substring(html, 1, most)
    groups = _groups(pattern)
    found = F.arrays_zip(*[F.regexp_extract_all(text, java, groups[n]).alias(n) for n in ("link", "title", "snippet") if n in groups])
    rest = [c for c in pages.columns if c != html]
    # rows are told apart by number, as two may be equal and a column may not compare
    numbered = pages.select(F.monotonically_increasing_id().alias("_row"), F.struct(*rest).alias("_rest"), found.alias("_found"))
    rows = numbered.select("_row", "_rest", F.posexplode("_found").alias("at", "r")).select("_row", "_rest", "at", "r.*")
    rows = rows.withColumn("link", strip(unescape(F.col("link")))).where(F.col("link").rlike("(?i)^https?://"))
    rows = rows.withColumns({n: plain_text(F.col(n)) if n in groups else F.lit("") for n in ("title", "snippet")})
    rows = rows.groupBy("_row", "link").agg(F.min(F.struct("at", "title", "snippet")).alias("r"), F.first("_rest").alias("_rest")).select("_row", "_rest", "link", "r.*")
    w = Window.partitionBy("_row").orderBy("at")
    rows = rows.withColumn("at", F.row_number().over(w)).where(F.col("at") <= top_k)
    return rows.withColumn("title", F.when(F.col("title") == "", F.col("link")).otherwise(F.col("title"))).select("_rest.*", "at", "link", "title", "snippet")


def _groups(pattern: str) -> dict[str, int]:
    """Number of each named group."""
    out, n, i = {}, 0, 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            i = pattern.index("]", i + 2)
        elif pattern[i] == "(" and (pattern[i + 1 : i + 2] != "?" or pattern[i + 1 : i + 4] == "?P<"):
            n += 1
            if m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
                out[m[1]] = n
        i += 1
    return out
