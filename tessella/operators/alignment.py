"""Two versions of one document put side by side: page mapping, merged layouts, catalogs, and page arithmetic.

Tables have a row per page or catalog entry, with doc as the document and page or ord as the place in it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import coerce_page, heading_key, strip
from tessella.operators import overlay
from tessella.operators.store import ordered_distinct
from tessella.session import ship_package

#: Characters of a line in a page's signature, its lines, and characters of a title.
SIGNATURE_CHARS, SIGNATURE_LINES, TITLE_CHARS = 80, 2, 160


def signature(text: Column) -> Column:
    """The keys of a page's first two lines that have one, joined by a bar."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\u000b\u000c\u0085\u2028\u2029]")
    keys = F.filter(F.transform(lines, lambda x: F.substring(heading_key(x), 1, SIGNATURE_CHARS)), lambda k: k != "")
    return F.array_join(F.slice(keys, 1, SIGNATURE_LINES), "|")


def same_page(a: str, b: str) -> bool:
    """Whether two signatures mean one page: equal, equal first lines, or one inside the other if both are long."""
    if not (a and b):
        return False
    firsts = [x.partition("|")[0] for x in (a, b)]
    if {a, firsts[0]} & {b, firsts[1]}:
        return True
    # fixed values: from how many characters on a first line, and a whole signature, may be inside the other
    return any(min(map(len, pair)) >= least and (pair[0] in b or pair[1] in a) for pair, least in ((firsts, 6), ((a, b), 12)))


def align(source: list[str], target: list[str]) -> dict[int, int]:
    """Source page to target page (from 1) by signatures; empty without a match.

    Each source page in turn looks for its place from where the one before has left off. Target pages that are blank,
    or whose next one is the source page while they aren't, are no place. A blank source page shares its place with the next
    one; a page that isn't the one at its place, while the page after it is, gets none. Pages
    after the last place keep the last offset.
    """
    placed: dict[int, int] = {}
    at, met, following = 0, False, [*target[1:], ""]
    for page, (own, after) in enumerate(zip(source, [*source[1:], ""], strict=False), 1):
        skipped = lambda j: not target[j] or (own and same_page(own, following[j]) and not same_page(own, target[j]))  # noqa: B023, E731
        at = next((j for j in range(at, len(target)) if not skipped(j)), len(target))
        if at == len(target):
            break
        same = same_page(own, target[at])
        met |= same
        if same or not own or not same_page(after, target[at]):
            placed[page] = at + 1
            at += bool(own)
    if not met:
        return {}
    last, place = max(placed.items())
    return {p: placed.get(p, min(max(p + place - last, 1), len(target))) for p in range(1, len(source) + 1)}


def map_pages(source: DataFrame, target: DataFrame) -> DataFrame:
    """(doc, page, mapped) of two versions (doc, page, text). Documents whose pages match nowhere have no rows.

    Only signatures are shuffled; the walk depends on its own steps, so a document's two lists meet in one task.
    """
    ship_package(source.sparkSession)
    one = lambda df, side: df.select("doc", F.lit(side).alias("side"), "page", signature(F.col("text")).alias("sig"))
    both = one(source, 0).unionByName(one(target, 1))
    lists = both.groupBy("doc").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == i, F.struct("page", "sig")))), lambda x: x["sig"]).alias(c) for i, c in enumerate("st")]
    )
    kind = source.schema["doc"].dataType.simpleString()

    def walk(batches):
        for b in batches:
            at, pages, mapped = [], [], []
            for i, (s, t) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                got = align(s, t)
                at += [i] * len(got)
                pages += got.keys()
                mapped += got.values()
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(pages, pa.int32()), pa.array(mapped, pa.int32())], names=["doc", "page", "mapped"])

    return lists.mapInArrow(walk, f"doc {kind}, page int, mapped int")


def target_ranges(ranges: DataFrame, mapping: DataFrame) -> DataFrame:
    """ranges (doc, ord, start, end) with start and end of the mapped pages (doc, page, mapped); those without pages are left out."""
    span = overlay.extent(ranges, mapping.select("doc", F.col("page").alias("at"), F.col("mapped").alias("value")))
    return ranges.drop("start", "end").join(span.select("doc", "ord", F.col("least").alias("start"), F.col("greatest").alias("end")), ["doc", "ord"])


LISTS = ("headers", "footers", "citations")


def merge_layouts(first: DataFrame, second: DataFrame) -> DataFrame:
    """Page by page, by position: the second version's texts before the first's, images the other way round; both distinct.

    Both: doc, at (position from 1), page, page_number, headers, footers, citations, images. A page that
    one version lacks comes from the other; page and page_number are the second's where it has them.
    """
    a, b = first.alias("a"), second.alias("b")
    both = a.join(b, ["doc", "at"], "full")
    none = F.array().cast("array<string>")
    get = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), none)
    number = lambda side: F.nullif(strip(F.col(f"{side}.page_number")), F.lit(""))
    return both.select(
        "doc", "at", F.coalesce(F.nullif("b.page", F.lit(0)), F.nullif("a.page", F.lit(0)), "at").alias("page"),
        *[ordered_distinct(F.concat(get("b", c), get("a", c))).alias(c) for c in LISTS],
        F.coalesce(number("b"), number("a"), F.lit("")).alias("page_number"),
        ordered_distinct(F.concat(get("a", "images"), get("b", "images"))).alias("images"),
    )


def append_tail(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc, page, text): the first version's pages, and the second's beyond their number if any of these has text."""
    n = first.groupBy("doc").agg(F.max("page").alias("n"))
    tail = second.join(n, "doc", "left").where(F.col("page") > F.coalesce("n", F.lit(0)))
    some = tail.groupBy("doc").agg(F.bool_or((strip(F.col("text")) != "") | F.col("n").isNull()).alias("some")).where("some").select("doc")
    return first.select("doc", "page", strip(F.col("text")).alias("text")).unionByName(tail.join(some, "doc", "left_semi").select("doc", "page", strip(F.col("text")).alias("text")))


def trim_blank_tail(pages: DataFrame) -> DataFrame:
    """pages (doc, page, text) up to the last one with some text."""
    last = pages.where(strip(F.coalesce("text", F.lit(""))) != "").groupBy("doc").agg(F.max("page").alias("last"))
    return pages.join(last, "doc").where("page <= last").drop("last")


def title_key(title: Column) -> Column:
    """Small letters without white space."""
    return F.regexp_replace(F.lower(strip(F.coalesce(title, F.lit("")))), r"(?U)\s+", "")


def normalise_catalog(entries: DataFrame) -> DataFrame:
    """entries (doc, ord, title, page, level): per title and level the one with the greatest page, the first of equal ones.

    Entries without a title or a page are left out. The order is by page, level, ord, title.
    """
    level = F.greatest(F.lit(1), F.coalesce(F.col("level").cast("int"), F.lit(1)))
    e = entries.withColumns({"title": strip(F.col("title")), "level": level}).where("title <> '' AND page > 0")
    e = e.withColumn("key", title_key(F.col("title"))).where("key <> ''").withColumn("title", F.substring("title", 1, TITLE_CHARS))
    best = F.max_by(F.struct("ord", "title", "page"), F.struct("page", -F.col("ord")))
    return e.groupBy("doc", "key", "level").agg(best.alias("r")).select("doc", "r.ord", "r.title", "r.page", "level", "key")


def richer_catalog(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per document one of two catalogs, normalised: the second if it is larger, or has max(3, n // 5) keys that the first of n lacks."""
    a, b = normalise_catalog(first), normalise_catalog(second)
    key = ["doc", "key", "level"]
    count = lambda df, name: df.groupBy("doc").agg(F.count("*").alias(name))
    n = count(a, "n").join(count(b, "m"), "doc", "full").join(count(key_difference(b, a, key), "more"), "doc", "left").fillna(0)
    takes = (F.col("m") > 0) & ((F.col("n") == 0) | (F.col("m") > F.col("n")) | (F.col("more") >= F.greatest(F.lit(3), F.floor(F.col("n") / 5))))
    chosen = n.select("doc", F.when(takes, F.lit(1)).otherwise(F.lit(0)).alias("side"))
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    return both.join(chosen, ["doc", "side"], "left_semi").select("doc", "ord", "title", "page", "level")


def key_difference(rows: DataFrame, others: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of rows that others lack."""
    return rows.select(*key).distinct().join(others.select(*key).distinct(), key, "left_anti")


def distinct_entries(entries: DataFrame) -> DataFrame:
    """entries (doc, ord, title, page, level): the first of each title key, page and level."""
    first = F.min_by(F.struct("ord", "title"), "ord")
    return entries.withColumn("key", title_key(F.col("title"))).groupBy("doc", "key", "page", "level").agg(first.alias("r")).select("doc", "r.ord", "r.title", "page", "level")


def first_leaves(leaves: DataFrame) -> DataFrame:
    """leaves (doc, ord, page, and more): the first one of each page above 0."""
    rest = [c for c in leaves.columns if c not in ("doc", "page")]
    first = F.min_by(F.struct(*rest), "ord")
    return leaves.where("page > 0").groupBy("doc", "page").agg(first.alias("r")).select("doc", "page", "r.*")


def catalog_quality(entries: DataFrame) -> DataFrame:
    """(doc, quality): struct(last page, entries, distinct pages, entries of level 1), which compares in this order."""
    return entries.groupBy("doc").agg(
        F.struct(F.max("page").alias("last"), F.count("*").alias("n"), F.count_distinct("page").alias("pages"), F.count(F.when(F.col("level") == 1, 1)).alias("tops")).alias("quality")
    )


def median_shift(hits: DataFrame, least: int = 3, most: int = 6) -> DataFrame:
    """(doc, shift): the rounded median of hit - page over hits (doc, page, hit), 0 for few or scattered ones."""
    d = F.col("hit") - F.col("page")
    got = hits.groupBy("doc").agg(F.count(d).alias("n"), (F.max(d) - F.min(d)).alias("spread"), F.bround(F.percentile(d, F.lit(0.5))).alias("m"))
    return got.select("doc", F.when((F.col("n") >= least) & (F.col("spread") <= most), F.col("m")).otherwise(F.lit(0)).cast("int").alias("shift"))


def rescale(page: Column, first: Column, last: Column, total: Column) -> Column:
    """A page of first..last as one of first..total, by line, half to even, inside 1..total."""
    line = F.bround(first + (page - first) * (total - first) / F.nullif(last - first, F.lit(0)))
    return F.greatest(F.lit(1), F.least(total, F.coalesce(line.cast("int"), page)))


def interpolate(markers: DataFrame, total: int) -> DataFrame:
    """markers (doc, ord, page, level, hit) with mapped: by lines through the level-1 markers' (page, hit), beyond them by the outer lines.

    Fewer than two such anchors leave the pages; of anchors of one page the first counts. Results are half to even, in 1..total.
    """
    anchor = F.when((F.col("level") == 1) & F.col("hit").isNotNull() & F.col("page").isNotNull(), F.struct("page", "hit"))
    a = markers.select("doc", "ord", anchor.alias("a")).where("a is not null").groupBy("doc", "a.page").agg(F.min_by("a.hit", "ord").alias("hit"))
    lists = a.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "hit"))).alias("s"))
    m = markers.join(lists, "doc", "left")
    n, p = F.size("s"), F.col("page")
    # the segment whose end reaches the page, from the second anchor to the last
    at = F.greatest(F.lit(2), F.least(n, F.size(F.filter("s", lambda x: x["page"] < p)) + 1))
    lo, hi = F.element_at("s", at - 1), F.element_at("s", at)
    line = F.bround(lo["hit"] + (p - lo["page"]) * (hi["hit"] - lo["hit"]) / (hi["page"] - lo["page"])).cast("int")
    return m.withColumn("mapped", F.when(n >= 2, F.greatest(F.lit(1), F.least(F.lit(total), line))).otherwise(p)).drop("s")


def top_ranges(hits: DataFrame, total: Column, least: int = 3) -> DataFrame:
    """hits (doc, ord, title, page) of first lines: each reaches to the page before the next, if a document has so many."""
    w = Window.partitionBy("doc")
    nxt = F.lead("page").over(w.orderBy("page", "ord"))
    rows = hits.withColumns({"n": F.count("*").over(w), "next": nxt}).where(F.col("n") >= least)
    return rows.select("doc", "ord", "title", F.col("page").alias("start"), F.greatest("page", F.coalesce(F.col("next") - 1, total)).alias("end"))


def carry_titles(pages: DataFrame) -> DataFrame:
    """(doc, title, start, end) of pages (doc, page, title or null): a title holds until the next; equal ones are one range."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    filled = pages.withColumn("title", F.last("title", ignorenulls=True).over(w)).where("title is not null")
    return filled.groupBy("doc", "title").agg(F.min("page").alias("start"), F.max("page").alias("end"))


def look_ahead(markers: DataFrame, headings: DataFrame, last: int, reach: int = 2) -> DataFrame:
    """markers (doc, ord, title, page, level) moved to the first page that has their heading, at most `reach` on and before the next boundary.

    headings: doc, page, key. A marker whose own page has it, or that is found nowhere, stays; pages end at `last`.
    """
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(1, 1)
    m = markers.withColumns({"key": heading_key(F.col("title")), "until": F.first("page").over(w)})
    h = headings.select("doc", "key", F.col("page").alias("at")).distinct()
    near = F.col("at").between(F.col("page"), F.least(F.col("page") + reach, F.greatest("page", F.coalesce(F.col("until"), F.lit(last)))))
    found = m.join(h, ["doc", "key"]).where(near).groupBy("doc", "ord").agg(F.min("at").alias("hit"))
    return m.join(found, ["doc", "ord"], "left").select("doc", "ord", "title", F.least(F.lit(last), F.coalesce("hit", "page")).alias("page"), "level")


def toc_pages(entries: DataFrame, markers: DataFrame) -> DataFrame:
    """markers (doc, ord, title, page) with the least page that a table of contents' entries (doc, title, page) give for the title."""
    least = entries.groupBy("doc", heading_key(F.col("title")).alias("key")).agg(F.min(coerce_page(F.col("page").cast("string"))).cast("int").alias("toc"))
    m = markers.withColumn("key", heading_key(F.col("title"))).join(least, ["doc", "key"], "left")
    return m.select("doc", "ord", "title", F.coalesce("toc", "page").alias("page"))
