"""Markdown blocks dealt to a number of slots: the largest block is halved until there are enough."""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Paragraphs and lines from which a text is cut between them, characters from which it is cut inside,
#: how far from the middle a sentence's end is looked for, and what ends one.
PARAGRAPHS, LINES, CHARS, REACH, SENTENCE = 2, 4, 480, 120, re.compile(r"[。！？!?]\s*")


def table_rows(block: str) -> list[str]:
    """The lines of a table with rows below its head; none for anything else."""
    lines = [x.rstrip() for x in block.splitlines() if x.strip()]
    table = len(lines) > 2 and all(x.lstrip().startswith("|") for x in lines[:2]) and "---" in lines[1]
    return lines if table else []


def halves(block: str) -> list[str]:
    """Two parts of a block, or the block if it can't be cut. Both parts of a table have its head."""
    if lines := table_rows(block):
        head, rows = lines[:2], lines[2:]
        cut = round(len(rows) / 2)
        return ["\n".join(head + part) for part in (rows[:cut], rows[cut:]) if part] if len(rows) > 1 else [block]
    for parts, joint, least in (
        ([x.strip() for x in re.split(r"\n{2,}", block) if x.strip()], "\n\n", PARAGRAPHS),
        ([x.rstrip() for x in block.splitlines() if x.strip()], "\n", LINES),
    ):
        if len(parts) >= least:
            return [joint.join(x).strip() for x in (parts[: len(parts) // 2], parts[len(parts) // 2 :])]
    if len(block) < CHARS:
        return [block]
    cut = len(block) // 2
    start = max(0, cut - REACH)
    if end := SENTENCE.search(block[start : cut + REACH]):
        cut = max(1, start + end.end())
    return [x for x in (block[:cut].strip(), block[cut:].strip()) if x]


def split_blocks(blocks: list[str], slots: int) -> list[str]:
    """`slots` texts of the blocks, in order.

    Too few blocks: the largest (of equal ones the first) is halved, until there are enough or it can't be cut; what is missing is empty.
    Too many: neighbours share slots, in proportion. A heap holds the sizes, and places are fractions between those of the neighbours.
    """
    parts = [x.strip() for x in blocks or [] if x and x.strip()]
    if slots <= 0 or not parts:
        return [""] * max(0, slots)
    heap = [(-len(x), (i,), x) for i, x in enumerate(parts)]
    heapq.heapify(heap)
    while len(heap) < slots:
        size, place, block = heap[0]
        two = halves(block)
        if len(two) < 2:
            break
        heapq.heapreplace(heap, (-len(two[0]), (*place, 0), two[0]))
        heapq.heappush(heap, (-len(two[1]), (*place, 1), two[1]))
    parts = [x for _, _, x in sorted(heap, key=lambda h: h[1])]
    dealt: list[list[str]] = [[] for _ in range(slots)]
    for i, x in enumerate(parts):
        dealt[min(slots - 1, i * slots // len(parts)) if len(parts) > slots else i].append(x)
    return ["\n\n".join(x) for x in dealt]


def slots_of(blocks: Column, slots: Column) -> Column:
    """split_blocks as a column: each cut depends on those before it."""

    @pandas_udf("array<string>")
    def run(b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([split_blocks(list(x) if x is not None else [], int(k)) for x, k in zip(b, n, strict=True)])

    return run(blocks, slots)
