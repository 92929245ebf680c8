"""Streams of text fragments put together: segments of text, thinking and tool calls per session, across batches.

Fragments carry a number in their session and can come late or in any order; what is next in order is taken at once, what
is early waits in state. Tags can be cut anywhere, so the end of a text that may become a tag is held back. A gap
that isn't filled within a time is passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.session import ship_package

#: Tags, and what stands between them.
TAGS = {"<think>": ("think", True), "</think>": ("think", False), "<tool>": ("tool", True), "</tool>": ("tool", False)}
SEGMENTS = "session string, n long, kind string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Milliseconds that a gap in the numbers may stay open.
PATIENCE = 60_000


@dataclass
class Splitter:
    """Where a session's text has come to: the open kind, its text so far, text held back, and how many segments are out."""

    kind: str = "text"
    text: str = ""
    held: str = ""
    n: int = 0

    def _out(self) -> Iterator[tuple[int, str, str]]:
        if self.text:
            yield self.n, self.kind, self.text
            self.n += 1
        self.text = ""

    def feed(self, fragment: str) -> Iterator[tuple[int, str, str]]:
        """Segments that the fragment ends. A tag that opens another kind ends the open one; one that closes what isn't open is dropped."""
        rest, self.held = self.held + fragment, ""
        while rest:
            head, mark, tail = rest.partition("<")
            self.text += head
            if not mark:
                return
            rest = mark + tail
            tag = next((t for t in TAGS if rest.startswith(t)), None)
            if tag:
                kind, opens = TAGS[tag]
                if opens or self.kind == kind:
                    yield from self._out()
                    self.kind = kind if opens else "text"
                rest = rest[len(tag) :]
            elif any(t.startswith(rest) for t in TAGS):
                self.held = rest
                return
            else:
                self.text, rest = self.text + mark, tail

    def close(self) -> Iterator[tuple[int, str, str]]:
        """The last segment, with what was held back."""
        self.text, self.held = self.text + self.held, ""
        yield from self._out()


def split_text(fragments: Iterable[str]) -> list[tuple[int, str, str]]:
    """All segments of one text that comes as fragments in order."""
    s = Splitter()
    out = [x for f in fragments for x in s.feed(f)]
    return out + list(s.close())


class Assembler(StatefulProcessor):
    """State of a session: the number that is next, the splitter, and early fragments."""

    def __init__(self, patience: int | None = PATIENCE):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, kind string, text string, held string, n long, done boolean")
        self.early = handle.getMapState("early", "seq long", "text string, last boolean")

    def _load(self) -> tuple[int, Splitter, bool]:
        if not self.place.exists():
            return 0, Splitter(), False
        at, kind, text, held, n, done = self.place.get()
        return at, Splitter(kind, text, held, n), done

    def _take(self, at: int, s: Splitter, done: bool, out: list) -> tuple[int, bool]:
        """Everything that is next in order."""
        while not done and self.early.containsKey((at,)):
            text, last = self.early.getValue((at,))
            self.early.removeKey((at,))
            out += s.feed(text or "")
            at, done = at + 1, bool(last)
        if done:
            out += s.close()
        return at, done

    def _rows(self, key, out: list) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["session", "n", "kind", "text"])

    def _wait(self, done: bool, timers) -> None:
        if self.patience is None:
            return
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if not done and next(iter(self.early.keys()), None) is not None:
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, s, done = self._load()
        if done:
            return
        for df in rows:
            for seq, text, last in zip(df["seq"], df["text"], df["last"], strict=True):
                if seq >= at and not self.early.containsKey((int(seq),)):  # a repeated number is the first one's
                    self.early.updateValue((int(seq),), (text, bool(last)))
        out: list = []
        at, done = self._take(at, s, done, out)
        self.place.update((at, s.kind, s.text, s.held, s.n, done))
        self._wait(done, timerValues)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, s, done = self._load()
        waiting = [k[0] for k in self.early.keys()]
        out: list = []
        if waiting and not done:
            at, done = self._take(min(waiting), s, done, out)
            self.place.update((at, s.kind, s.text, s.held, s.n, done))
        self._wait(done, timerValues)
        yield from self._rows(key, out)


def segments(fragments: DataFrame, patience: int | None = PATIENCE) -> DataFrame:
    """(session, n, kind, text) of a stream or table of fragments (session, seq from 0, text, last).

    A segment comes out when a tag ends it, or after the fragment that is marked as last; later fragments of the session are
    ignored then. Null text is empty. Fragments without a session or a number are left out. patience: milliseconds that a gap may
    stay open; None leaves it open, and such a stream can end when all is read (timers keep one going).
    """
    ship_package(fragments.sparkSession)
    fragments.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = fragments.where("session is not null and seq is not null").select(F.col("session").cast("string").alias("session"), F.col("seq").cast("long").alias("seq"), "text", F.coalesce("last", F.lit(False)).alias("last"))
    return rows.groupBy("session").transformWithStateInPandas(
        statefulProcessor=Assembler(patience), outputStructType=SEGMENTS, outputMode="append", timeMode="none" if patience is None else "processingTime"
    )


def written_segments(spark: SparkSession, fragments: DataFrame, folder: str) -> DataFrame:
    """The segments of a stream of files, written until all files that are there have been read, and read back."""
    query = segments(fragments, None).writeStream.format("parquet").option("path", f"{folder}/segments").option("checkpointLocation", f"{folder}/progress")
    query.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(SEGMENTS).parquet(f"{folder}/segments")
