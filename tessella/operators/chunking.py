"""Splitting texts: pages, fragments within a character budget, contiguous parts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.session import ship_package

#: Where to cut, in order of preference.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ".", "!", "?", "；", ";", "，", ",", " "]
#: The same for windows that overlap, and by how much.
OVERLAP_SEPARATORS, OVERLAP = ["\n\n", "\n", "。", "！", "？", "；", "，", " "], 180

#: Pieces that a worker holds before it hands them on.
HELD_PIECES = 1000


def split_budget(text: str | None, budget: int = 1200, separators: list[str] | None = None, overlap: int = 0) -> list[str]:
    """Pieces of at most max(200, budget) characters.

    A window ends after the last occurrence of the first separator that is found past its start,
    else at its full size; pieces are stripped and empty ones dropped. overlap: the next window
    begins so many characters before the end of the last, but past its start.
    """
    text, budget, out, at = (text or "").strip(), max(200, budget), [], 0
    while len(text) - at > budget:
        cut = at + budget
        for s in separators or SEPARATORS:
            found = text.rfind(s, at, at + budget)
            if found > at:
                cut = found + len(s)
                break
        out.append(text[at:cut].strip())
        at = max(at + 1, cut - overlap) if overlap else cut
    out.append(text[at:].strip())
    return [x for x in out if x]


def chunks(docs: DataFrame, budget: int = 1200, overlap: int = 0) -> DataFrame:
    """(doc_id, chunk_index from 0, chunk_count, text) of docs (doc_id, text). One pass, no shuffle.

    The windows depend on one another, so this is an Arrow function; columns beside the two are not read.
    """
    ship_package(docs.sparkSession)

    def batch(rows):
        cols = zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], names=["doc_id", "chunk_index", "chunk_count", "text"])

    def cut(batches):
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0), b.column(1), strict=True):
                pieces = split_budget(text.as_py(), budget, OVERLAP_SEPARATORS if overlap else SEPARATORS, overlap)
                at = doc_id.as_py()
                rows += [(at, i, len(pieces), p) for i, p in enumerate(pieces)]
                if len(rows) >= HELD_PIECES:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, chunk_index int, chunk_count int, text string")


def chunk_rows(chunked: DataFrame, doc_name: Column, section: Column) -> DataFrame:
    """Rows of a search index: an identifier made of document, kind and section, and the text."""
    part = F.concat_ws("::", section, F.lit("fragment"), F.col("chunk_index").cast("string"))
    kind = F.when(F.col("chunk_count") > 1, "semipage").otherwise("monopage")
    key = F.concat_ws("::", doc_name, kind, F.when(F.col("chunk_count") > 1, part).otherwise(section))
    return chunked.select(key.alias("chunk_id"), "doc_id", "chunk_index", "chunk_count", "text")


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page from 1, text): pages end at form feeds; blank pages count."""
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\f")
    return docs.select("doc_id", F.posexplode(parts).alias("page", "text")).select(
        "doc_id", (F.col("page") + 1).alias("page"), strip(F.col("text")).alias("text")
    )


def force_pages(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, page from 1 to n, text): the lines dealt to n pages, cut at round-half-even(i * lines / n)."""
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    at = lambda i: F.bround(i * F.size("lines") / F.lit(n)).cast("int")
    page = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("page")
    return docs.select("doc_id", lines.alias("lines")).select("doc_id", "lines", page).select(
        "doc_id", "page",
        strip(F.array_join(F.slice("lines", at(F.col("page") - 1) + 1, at(F.col("page")) - at(F.col("page") - 1)), "\n")).alias("text"),
    )


def source_page(target: Column, sources: int, targets: int) -> Column:
    """The source page that stands for a target page (from 1), by proportion."""
    return F.least(F.greatest(F.floor((target - 1) * sources / targets) + 1, F.lit(1)), F.lit(sources)).cast("int")


def contiguous_part(ordinal: Column, count: Column, parts: int) -> Column:
    """Which of `parts` runs (from 0) an item (from 0) belongs to, the runs being cut at round-half-even(i * count / parts)."""
    cuts = F.transform(F.sequence(F.lit(1), F.lit(parts)), lambda i: F.bround(i * count / F.lit(parts)).cast("int"))
    return F.size(F.filter(cuts, lambda c: c <= ordinal))
