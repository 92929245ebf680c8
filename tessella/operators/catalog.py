"""Catalogs: markers of headings, page ranges, paths, and the joins between pages and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.functions.text import heading_key, heading_title
from tessella.operators import overlay
from tessella.session import cut_lineage, ship_package


def ranges(markers: DataFrame, total_pages: Column) -> DataFrame:
    """(doc, ord, title, start, end, level): a marker reaches to the page before the next marker of no deeper level.

    markers: doc, ord, title, page, level. A null or zero page or an empty title makes no range; the
    next boundary is the first later marker with a page and a level not deeper. A range never ends
    before it starts; without a boundary it ends with the document.
    """
    m = markers.withColumn("level", F.coalesce(F.nullif("level", F.lit(0)), F.lit(1)))
    m = overlay.open_rows(m, -F.col("ord"), "page", strict=False, counts=F.col("page").isNotNull())
    boundary = F.try_element_at("open", F.lit(-1))
    end = F.when(boundary.isNotNull(), boundary - 1).otherwise(total_pages)
    title = heading_title(F.col("title"))
    return m.where((F.col("page") > 0) & (title != "")).select(
        "doc", "ord", title.alias("title"), F.col("page").alias("start"), F.greatest("page", end).alias("end"),
        F.least(F.greatest("level", F.lit(1)), F.lit(6)).alias("level"),
    )


def paths(rows: DataFrame) -> DataFrame:
    """rows (doc, ord, title, level from 1) with path: the titles of the nearest earlier shallower rows and its own."""
    r = overlay.open_rows(rows, F.col("ord"), "title")
    return r.withColumn("path", F.array_join(F.concat("open", F.array("title")), "/")).drop("open")


def best_section(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages (doc, page) with the deepest, narrowest, earliest range that holds them; pages without one are left out.

    Ranges are swept over the pages; what is joined after is one range per page. Both joins are by sorted sides: pages
    that are made from few rows, and ranges out of Python, are larger than their plans' sizes tell, so neither may be broadcast by these.
    """
    best = overlay.cover(pages.select("doc", "page").distinct(), sections).where("ord is not null")
    return pages.hint("merge").join(best.hint("merge"), ["doc", "page"]).join(sections.hint("merge"), ["doc", "ord"])


def section_runs(pages: DataFrame) -> DataFrame:
    """(doc, path, level, start, end) of runs of consecutive pages under each prefix of their path (parts by /).

    A document's pages are sorted once and read as a stream; what is held is the last run of each of its prefixes.
    """
    ship_package(pages.sparkSession)
    doc, page = pages.schema["doc"].dataType, pages.schema["page"].dataType
    schema = StructType().add("doc", doc).add("path", "string").add("level", "integer").add("start", page).add("end", page)

    def walk(batches):
        def rows():
            for (key,), run in overlay._streams(batches, 1):
                last: dict[tuple, list] = {}
                for at, path in run:
                    parts = path.split("/")
                    for k in range(1, len(parts) + 1):
                        p = "/".join(parts[:k])
                        held = last.get(p)
                        if held and (at == held[2] or (held[2] is not None and at == held[2] + 1)):
                            held[2] = at
                            continue
                        if held:
                            yield key, p, *held
                        last[p] = [k, at, at]
                for p, held in last.items():
                    yield key, p, *held

        yield from overlay._batches(rows(), overlay._arrow(schema))

    return pages.where("path <> ''").select("doc", "page", "path").repartition("doc").sortWithinPartitions("doc", "page").mapInArrow(walk, schema)


def _keyed(headings: DataFrame) -> DataFrame:
    """headings (doc, page, and text or its digest) with key: the digest, as keys can be as long as lines."""
    return headings if "key" in headings.columns else headings.withColumn("key", digest(F.col("text")))


def digest(text: Column) -> Column:
    """Digest of a heading's key."""
    return F.md5(heading_key(text))


def remap_by_hits(markers: DataFrame, headings: DataFrame) -> DataFrame:
    """markers with the least page, inside the span of their level-1 marker, of a heading of the same key.

    markers: doc, ord, title, page, level; headings: doc, page, and text or `digest` of it as key. A marker without a hit keeps its page.
    """
    w = Window.partitionBy("doc").orderBy("ord")
    top = F.sum((F.col("level") == 1).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = markers.withColumns({"key": digest(F.col("title")), "seg": top})
    segs = m.where("level = 1").select("doc", "seg", F.col("page").alias("lo"))
    segs = segs.withColumn("hi", F.lead("lo").over(Window.partitionBy("doc").orderBy("seg")))
    h = _keyed(headings).select("doc", F.col("page").alias("at"), "key")
    m = m.join(segs, ["doc", "seg"], "left")
    inside = (F.col("at") >= F.coalesce("lo", F.lit(1))) & (F.col("hi").isNull() | (F.col("at") < F.greatest("hi", F.col("lo") + 1)))
    hits = m.join(h, ["doc", "key"]).where(inside).groupBy("doc", "ord").agg(F.min("at").alias("hit"))
    return m.join(hits, ["doc", "ord"], "left").select("doc", "ord", "title", F.coalesce("hit", "page").alias("page"), "level")


def prune_tail(markers: DataFrame, headings: DataFrame) -> DataFrame:
    """markers without the level-1 segments after the last one that has a heading, if two or more have one and two or more follow."""
    top = F.sum((F.col("level") == 1).cast("int")).over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    m = markers.withColumns({"key": digest(F.col("title")), "seg": top})
    keys = _keyed(headings).select("doc", "key").distinct()
    supported = m.join(keys, ["doc", "key"], "left_semi").groupBy("doc").agg(F.max("seg").alias("last"), F.count_distinct("seg").alias("n"))
    count = m.groupBy("doc").agg(F.max("seg").alias("segs"))
    limits = count.join(supported, "doc", "left")
    cut = (F.col("n") >= 2) & (F.col("segs") - F.col("last") >= 2)
    return m.join(limits, "doc").where(~F.coalesce(cut, F.lit(False)) | (F.col("seg") <= F.col("last"))).select("doc", "ord", "title", "page", "level")


def project_pages(pages: DataFrame, anchors: DataFrame, target_pages: int) -> DataFrame:
    """pages (doc, page) with mapped: through anchors (doc, src, dst) by line, half to even; beyond them by the edge's offset.

    A document's anchors and pages are sorted once and read as a stream; what is held are the pages since the last anchor.
    """
    ship_package(pages.sparkSession)
    none = F.lit(None).cast("int")
    union = anchors.select("doc", F.col("src").cast("int").alias("at"), F.lit(0).alias("probe"), F.col("dst").cast("int").alias("dst")).unionByName(
        pages.select("doc", F.col("page").cast("int").alias("at"), F.lit(1).alias("probe"), none.alias("dst"))
    )
    schema = StructType().add("doc", pages.schema["doc"].dataType).add("page", "integer").add("mapped", "integer")

    def between(p: int, lo: tuple | None, hi: tuple | None) -> int:
        if lo is None:
            return p if hi is None else p + hi[1] - hi[0]
        if hi is None or lo[0] == p:
            return p + lo[1] - lo[0]
        return round(lo[1] + (p - lo[0]) / (hi[0] - lo[0]) * (hi[1] - lo[1]))

    def walk(batches):
        def rows():
            for (key,), run in overlay._streams(batches, 1):
                lo, held = None, []
                for at, probe, dst in run:
                    if probe:
                        held.append(at)
                        continue
                    for p in held:
                        yield key, p, max(1, min(target_pages, between(p, lo, (at, dst))))
                    lo, held = (at, dst), []
                for p in held:
                    yield key, p, max(1, min(target_pages, between(p, lo, None)))

        yield from overlay._batches(rows(), overlay._arrow(schema))

    return union.repartition("doc").sortWithinPartitions("doc", "at", "probe").mapInArrow(walk, schema)


def boundary_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, matched, precision, recall, f1) of two assignments (doc, page, section); a boundary is a page where the section changes."""

    def changes(df: DataFrame) -> DataFrame:
        before = F.lag("section").over(Window.partitionBy("doc").orderBy("page"))
        return df.withColumn("before", before).where("before is not null and before <> section").select("doc", "page")

    same = a.alias("a").join(b.alias("b"), ["doc", "page"], "full").groupBy("doc").agg(
        F.round(F.avg((F.coalesce(F.col("a.section"), F.lit("")) == F.coalesce(F.col("b.section"), F.lit(""))).cast("double")), 6).alias("matched")
    )
    x, y = changes(a).withColumn("in_a", F.lit(1)), changes(b).withColumn("in_b", F.lit(1))
    n = x.join(y, ["doc", "page"], "full").groupBy("doc").agg(
        F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull(), 1)).alias("both"), F.count("in_a").alias("na"), F.count("in_b").alias("nb")
    )
    ratio = lambda p, q: F.round(F.when(q > 0, p / q).otherwise(F.lit(0.0)), 6)
    got = same.join(n, "doc", "left").fillna(0, ["both", "na", "nb"])
    return got.select(
        "doc", "matched", ratio(F.col("both"), F.col("na")).alias("precision"), ratio(F.col("both"), F.col("nb")).alias("recall"),
        ratio(2 * F.col("both"), F.col("na") + F.col("nb")).alias("f1"),
    )


def tree_edges(nodes: DataFrame) -> DataFrame:
    """nodes (doc, ord, title, level) with parent: ord of the nearest earlier node of a smaller level."""
    return overlay.open_rows(nodes, F.col("ord"), "ord").withColumn("parent", F.try_element_at("open", F.lit(-1))).drop("open")


def closure(edges: DataFrame) -> DataFrame:
    """(doc, ancestor, node, distance) of edges (doc, ord, parent), each node its own at 0, to any depth.

    Links are doubled until none is left, so a tree of depth d takes log2(d) joins. Nodes on a circle, or below one, have
    no root: as a tree of n nodes is no deeper than n, what is still linked after log2(n) rounds is one of these; an error names a document.
    """
    far = cut_lineage(edges.where("parent is not null").select("doc", F.col("ord").alias("node"), F.col("parent").alias("ancestor")))
    reach = edges.select("doc", F.col("ord").alias("node"), F.col("ord").alias("ancestor"), F.lit(0).alias("distance"))
    most = edges.groupBy("doc").count().agg(F.max("count")).first()[0] or 0
    size = 1
    while (left := far.first()) is not None:
        if size > most:
            raise ValueError(f"the edges of document {left.doc!r} run in a circle")
        step = far.select("doc", F.col("node").alias("ancestor"), F.col("ancestor").alias("up"))
        onward = reach.join(step, ["doc", "ancestor"]).select("doc", "node", F.col("up").alias("ancestor"), (F.col("distance") + size).alias("distance"))
        reach = cut_lineage(reach.unionByName(onward))
        far = cut_lineage(far.join(step, ["doc", "ancestor"]).select("doc", "node", F.col("up").alias("ancestor")))
        size *= 2
    return reach.select("doc", "ancestor", "node", "distance")


def roll_up(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, ord, merged, first_page, last_page): the texts of a node's leaves in order, and their pages.

    edges: doc, ord, parent; texts: doc, ord, page, text. Blank texts are left out of the joined text.
    """
    parents = edges.where("parent is not null").select("doc", F.col("parent").alias("ord")).distinct()
    leaves = texts.join(parents, ["doc", "ord"], "left_anti")
    down = closure(edges).select("doc", "ancestor", F.col("node").alias("ord"))
    got = down.join(leaves, ["doc", "ord"]).groupBy("doc", "ancestor").agg(
        F.sort_array(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", "text")))).alias("t"),
        F.min("page").alias("first_page"), F.max("page").alias("last_page"),
    )
    return got.select("doc", F.col("ancestor").alias("ord"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("merged"), "first_page", "last_page")


def catalog_lines(rows: DataFrame) -> DataFrame:
    """rows (doc, ord, title, page, end, level) with line: a drawn prefix by level, the last of a run closed, title and pages.

    Rows that are equal in pages, level and title go by ord, so lines don't depend on how rows arrive.
    """
    order = ["page", "level", F.col("end").desc(), "title", "ord"]
    nxt = F.lead("level").over(Window.partitionBy("doc").orderBy(*order))
    closed = nxt.isNull() | (nxt < F.col("level"))
    indent = F.repeat(F.lit("│  "), F.col("level") - 1)
    mark = F.when(closed, F.lit("└─ ")).otherwise(F.lit("├─ "))
    return rows.withColumn("line", F.concat(indent, mark, F.col("title"), F.format_string(" (%d-%d)", "page", "end")))
