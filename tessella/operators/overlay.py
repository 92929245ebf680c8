"""Ranges laid over pages by a sweep: each page's best range, each range's least and greatest value, open rows of an outline.

A document's rows are sorted by position once and read as a stream; what is held are the ranges that are open at the moment,
never pages times ranges. Long documents are cut into blocks of pages, which are swept on their own; a range
is in every block that it touches.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from tessella.session import ship_package

#: Pages of a document that are swept together.
BLOCK = 1 << 16


def best_cover(events: Iterable[tuple]) -> Iterator[tuple]:
    """(page's payload, range's payload or None) for each page of a sorted stream.

    events: (position, 0, order, end, payload) opens a range, (position, 1, None, None, payload) is a page. Of the
    ranges that hold a page the one with the least order is its; a range that is over is dropped when it comes up.
    """
    held: list[tuple] = []
    for n, (at, page, order, end, payload) in enumerate(events):
        if not page:
            heapq.heappush(held, (order, n, end, payload))
            continue
        while held and held[0][2] < at:
            heapq.heappop(held)
        yield payload, held[0][3] if held else None


def _streams(batches, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows with equal first columns, each as (these, rows of the rest)."""
    from itertools import groupby

    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, run in groupby(rows, lambda r: r[:keys]):
        yield key, (r[keys:] for r in run)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _blocks(first: Column, last: Column) -> Column:
    block = lambda c: F.floor(c / F.lit(BLOCK)).cast("int")
    return F.explode(F.sequence(block(first), F.greatest(block(first), block(last))))


def cover(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """pages (doc, page) with ord of the deepest, then narrowest, then earliest range that holds them; null where none does.

    ranges: doc, ord, start, end, level. Equal pages are one row each; a range that ends before it starts holds nothing.
    """
    ship_package(pages.sparkSession)
    doc = pages.schema["doc"].dataType.simpleString()
    whole = ranges.where(F.col("end") >= F.col("start")).select("doc", *[F.col(c).cast("int").alias(c) for c in ("ord", "start", "end", "level")])
    opens = whole.withColumn("block", _blocks(F.col("start"), F.col("end"))).select(
        "doc", "block", F.greatest("start", F.col("block") * BLOCK).alias("at"), F.lit(0).alias("page"), "level", F.col("start").alias("begin"), "end", "ord"
    )
    none = F.lit(None).cast("int")
    asked = pages.select("doc", F.floor(F.col("page") / F.lit(BLOCK)).cast("int").alias("block"), F.col("page").cast("int").alias("at"), F.lit(1).alias("page"), none.alias("level"), none.alias("begin"), none.alias("end"), none.alias("ord"))
    schema = StructType().add("doc", pages.schema["doc"].dataType).add("page", "integer").add("ord", "integer")

    def sweep(batches):
        def rows():
            for (key, _), run in _streams(batches, 2):
                events = ((at, page, None if page else (-level, end - begin, begin, o), end, at if page else o) for at, page, level, begin, end, o in run)
                for at, o in best_cover(events):
                    yield key, at, o

        yield from _batches(rows(), _arrow(schema))

    dealt = opens.unionByName(asked).repartition("doc", "block").sortWithinPartitions("doc", "block", "at", "page")
    return dealt.mapInArrow(sweep, f"doc {doc}, page int, ord int")


def extent(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """(doc, ord, least, greatest) of the values of points (doc, at, value) inside ranges (doc, ord, start, end); empty ranges are left out.

    Points are read in order and those are held that are still the least or greatest of all that follow up to now, so a range
    finds its answer by binary search when it ends.
    """
    ship_package(ranges.sparkSession)
    doc = ranges.schema["doc"].dataType
    none = F.lit(None).cast("int")
    at = points.select("doc", F.col("at").cast("int").alias("at"), F.lit(0).alias("side"), F.col("value").cast("int").alias("value"), none.alias("start"), none.alias("ord"))
    asked = ranges.select("doc", F.col("end").cast("int").alias("at"), F.lit(1).alias("side"), none.alias("value"), F.col("start").cast("int").alias("start"), F.col("ord").cast("int").alias("ord"))
    schema = StructType().add("doc", doc).add("ord", "integer").add("least", "integer").add("greatest", "integer")

    def sweep(batches):
        def rows():
            for (key,), run in _streams(batches, 1):
                low, high = ([], []), ([], [])
                for where, side, value, start, o in run:
                    if side:
                        i = bisect_left(low[0], start)
                        if i < len(low[0]) and low[0][i] <= where:
                            yield key, o, low[1][i], high[1][bisect_left(high[0], start)]
                        continue
                    if value is None:
                        continue
                    for (places, values), sign in ((low, 1), (high, -1)):
                        while values and values[-1] * sign >= value * sign:
                            places.pop(), values.pop()
                        places.append(where), values.append(value)

        yield from _batches(rows(), _arrow(schema))

    dealt = at.unionByName(asked).repartition("doc").sortWithinPartitions("doc", "at", "side")
    return dealt.mapInArrow(sweep, f"doc {doc.simpleString()}, ord int, least int, greatest int")


def open_rows(rows: DataFrame, order: Column, value: str, strict: bool = True, counts: Column | None = None) -> DataFrame:
    """rows (doc, level, and more) with `open`: `value` of the earlier rows (by order) that are still open, outermost first.

    A row closes the earlier ones of its level and deeper ones. strict: only shallower rows are listed, else equal levels
    too. counts: whether a row is there for later ones; one that isn't closes nothing. What is held is one row per open level,
    whatever the document's size.
    """
    ship_package(rows.sparkSession)
    names = rows.columns
    kept = rows.withColumns({"_counts": F.coalesce(counts, F.lit(False)) if counts is not None else F.lit(True), "_order": order})
    schema = StructType(list(rows.schema.fields)).add("open", ArrayType(rows.schema[value].dataType))
    doc_at, level_at, value_at = names.index("doc"), names.index("level"), names.index(value)

    def walk(batches):
        now, stack = object(), []
        for b in batches:
            out = []
            docs, levels, values, counted = (b.column(i).to_pylist() for i in (doc_at, level_at, value_at, len(names)))
            for d, level, v, c in zip(docs, levels, values, counted, strict=True):
                if d != now:
                    now, stack = d, []
                above = [x for k, x in stack if k < level or (k == level and not strict)]
                out.append(above)
                if c:
                    while stack and stack[-1][0] >= level:
                        stack.pop()
                    stack.append((level, v))
            got = pa.array(out, pa.list_(b.column(value_at).type))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), got], names=[*names, "open"])

    return kept.repartition("doc").sortWithinPartitions("doc", "_order").mapInArrow(walk, schema)
