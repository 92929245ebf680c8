"""Filters, scores, orders and pages of search rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.chunking import chunks
from tessella.session import cut_lineage

#: Characters of a search row's text, and rows of an answer.
ROW_CHARS, MOST_ROWS = 1400, 50


def search_rows(docs: DataFrame, section: str = "source") -> DataFrame:
    """Rows of a search over docs (doc_id, text): doc_id, section, section_id, parent_section_id, page, page_start, page_end, text.

    A row is a fragment of at most 1200 characters, so every part of a text is searched; a fragment
    stands for a page. Documents without text have none.
    """
    parts = chunks(docs).join(docs.select("doc_id", F.col(section).alias("section")).distinct(), "doc_id")
    page = F.col("chunk_index") + 1
    own = F.concat_ws("::", F.col("doc_id").cast("string"), F.when(F.col("chunk_count") > 1, "semipage").otherwise("monopage"), F.col("chunk_index").cast("string"))
    return parts.select(
        "doc_id", "section", own.alias("section_id"), F.col("doc_id").cast("string").alias("parent_section_id"),
        page.alias("page"), page.alias("page_start"), page.alias("page_end"), F.substring("text", 1, ROW_CHARS).alias("text"),
    )


def search_filter(
    rows: DataFrame, regex: str | None = None, section: str | None = None, chunk: str | None = None,
    page_start: int | None = None, page_end: int | None = None,
) -> DataFrame:
    """Rows that meet every given condition; rows without page bounds fail a page condition."""
    ok = F.lit(True)
    if section:
        ok &= F.contains(F.lower("section"), F.lit(section.lower()))
    if chunk:
        ok &= F.contains(F.lower("text"), F.lit(chunk.lower()))
    if regex:
        ok &= F.col("text").rlike(f"(?im){regex}")
    if page_start is not None:
        ok &= F.col("page_end") >= page_start
    if page_end is not None:
        ok &= F.col("page_start") <= page_end
    return rows.where(ok)


def first_of(*cols: str) -> Column:
    """The first that is neither null nor 0."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in cols])


def best(rows: DataFrame, limit: int, *ties: str) -> DataFrame:
    """The first of rows by score, at most 50; spread sorting keeps so many per partition only."""
    return rows.orderBy(F.col("score").desc(), *ties).limit(max(1, min(limit, MOST_ROWS)))


def group_score(text: Column, pattern: str, weights: list[float]) -> Column:
    """Sum of the weights of those groups that aren't empty in the first match."""
    groups = [F.when(F.regexp_extract(text, f"(?im){pattern}", i) != "", F.lit(w)).otherwise(F.lit(0.0)) for i, w in enumerate(weights, 1)]
    total = F.lit(0.0)
    for g in groups:
        total = total + g
    return total


def paginate(ranked: DataFrame, page: int, size: int) -> DataFrame:
    """The rows of one page of ranked (with rank from 1); page and size are clamped, pages added."""
    size = max(1, min(size, MOST_ROWS))
    n = ranked.agg(F.greatest(F.lit(1), F.ceil(F.max("rank") / size)).cast("int").alias("pages"))
    n = n.select(F.coalesce("pages", F.lit(1)).alias("pages"))
    now = F.greatest(F.lit(1), F.least(F.lit(page), F.col("pages")))
    return ranked.join(F.broadcast(n)).where((F.col("rank") > (now - 1) * size) & (F.col("rank") <= now * size)).withColumn("page", now)


def page_command(command: Column, current: Column, pages: Column) -> Column:
    """Target page of `first`, `last`, `+n`, `-n`, `n`, clamped; null for anything else."""
    c = F.lower(F.trim(command))
    n = F.regexp_extract(c, r"^[+-]?(\d+)$", 1).try_cast("int")
    target = (
        F.when(c == "first", F.lit(1)).when(c == "last", pages).when(c.startswith("+"), current + n).when(c.startswith("-"), current - n).otherwise(n)
    )
    return F.when(target.isNotNull(), F.greatest(F.lit(1), F.least(target, pages)))


def within_budget(rows: DataFrame, order: list[str], budget: int, by: list[str]) -> DataFrame:
    """Of each group, the first rows whose texts fit the budget together; the first that doesn't fit ends it.

    Rows that are equal in by and order count once. Sums run within ranges of the order, and what a group
    has before a range comes from a row per group and range, so a group of any size is no task's own.
    """
    keys = [*by, *order]
    one = rows.dropDuplicates(keys)
    ranged = cut_lineage(one.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    size = F.length(F.coalesce("text", F.lit("")))
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ranged.groupBy(*by, "_part").agg(F.sum(size).alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).where(F.col("_before") <= budget)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_part"]]
    joined = ranged.alias("r").join(carried.alias("c"), reduce(and_, same)).select("r.*", "_before")
    return joined.withColumn("running", F.col("_before") + F.sum(size).over(within)).where(F.col("running") <= budget).drop("_before", "_part")


def overlap_score(query: Column, text: Column, most: int = 4000) -> Column:
    """Share of the query's distinct words that the text's first characters hold (a limit of the ranking)."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)(\w+)"), 1))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(F.substring(text, 1, most)))) / F.size(q)).otherwise(F.lit(0.0))


def best_tier(names: DataFrame, query: str) -> DataFrame:
    """Names that a query means: equal path, else relative path, else file name, else stem; the first tier that has any."""
    q = query.strip().lower()
    n = F.lower("name")
    base = F.substring_index(n, "/", -1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    tier = F.when(n == q, 1).when(n.endswith("/" + q), 2).when(base == q, 3).when(stem == q, 4)
    found = names.withColumn("tier", tier).where(F.col("tier").isNotNull())
    least = found.agg(F.min("tier").alias("least"))
    return found.join(F.broadcast(least)).where("tier = least").drop("least")


def page_states(commands: DataFrame, size: int) -> DataFrame:
    """(session, ord, command, page, ok) of paging commands (session, ord, command, results): the page that each leads to.

    A session begins on page 1 of ceil(results / size) pages; a command that isn't one changes nothing. Each
    step needs the one before it, so a session's commands are folded in one row.
    """
    pages = F.greatest(F.lit(1), F.ceil(F.col("results") / size).cast("int"))
    row = F.struct("ord", "command", pages.alias("pages"))
    lists = commands.groupBy("session").agg(F.array_sort(F.collect_list(row)).alias("l"))
    none = F.array().cast("array<struct<ord:bigint,command:string,page:int,ok:boolean>>")

    def step(s, c):
        target = page_command(c["command"], s["page"], c["pages"])
        page = F.coalesce(target, F.least(s["page"], c["pages"])).cast("int")
        done = F.struct(c["ord"].cast("long").alias("ord"), c["command"].alias("command"), page.alias("page"), target.isNotNull().alias("ok"))
        return F.struct(page.alias("page"), F.concat(s["out"], F.array(done)).alias("out"))

    out = F.aggregate("l", F.struct(F.lit(1).alias("page"), none.alias("out")), step, lambda s: s["out"])
    return lists.select("session", F.explode(out).alias("r")).select("session", "r.*")
