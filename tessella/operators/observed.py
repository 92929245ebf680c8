"""Metrics and progress of jobs, observed on the plans that do the work: no second pass over the data.

Counts come with the action that writes a table (`Observation`), are kept as rows of (job, ord, doc, stage, name, value), and are
folded into a job's state by sessions.job_states like any other stage events. A stream's progress comes from a listener.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

EVENTS = "job string, ord long, doc string, stage string, name string, value long"
#: Events that a listener keeps; older ones are counted only.
KEPT = 10_000


class StageLog:
    """Stage events of jobs in a folder; each call appends. Failing to write is never the job's failure."""

    def __init__(self, spark: SparkSession, folder: str, job: str):
        self.spark, self.folder, self.job, self.ord, self.lost = spark, folder, job, 0, 0

    def _append(self, df: DataFrame) -> None:
        try:
            df.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.mode("append").parquet(self.folder)
        except Exception:  # noqa: BLE001  a side channel
            self.lost += 1

    def emit(self, stage: str, **values: int) -> None:
        """One event of the whole job, and a row for each value."""
        self.ord += 1
        rows = [(self.job, self.ord, None, stage, n, int(v)) for n, v in (values or {"n": 1}).items()]
        self._append(self.spark.createDataFrame(rows, EVENTS))

    def emit_documents(self, docs: DataFrame, stage: str) -> None:
        """An event for each document (doc_id), written where the documents are."""
        self.ord += 1
        one = docs.select(F.lit(self.job).alias("job"), F.lit(self.ord).cast("long").alias("ord"), F.col("doc_id").cast("string").alias("doc"), F.lit(stage).alias("stage"), F.lit("n").alias("name"), F.lit(1).cast("long").alias("value"))
        self._append(one)

    def read(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(self.folder)


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df and what to ask for the metrics after an action on it."""
    o = Observation()
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o


def written(df: DataFrame, path: str, log: StageLog | None = None, stage: str = "index_completed", **metrics: Column) -> dict[str, int]:
    """Write df as Parquet and return its metrics (rows as a rule), which go to the log as well."""
    seen, o = observed(df, **({"rows": F.count(F.lit(1))} | metrics))
    seen.write.parquet(path)
    got = {n: int(v or 0) for n, v in o.get.items()}
    if log is not None:
        log.emit(stage, **got)
    return got


class ProgressListener(StreamingQueryListener):
    """Stage events of streaming queries: started, rows of each batch that has some, and the end, with its error."""

    def __init__(self):
        self.events: deque[tuple] = deque(maxlen=KEPT)
        self.rows: dict[str, int] = {}

    def onQueryStarted(self, event):
        self.events.append((str(event.runId), "job_started", 0))

    def onQueryProgress(self, event):
        p = event.progress
        if p.numInputRows:
            self.rows[str(p.runId)] = self.rows.get(str(p.runId), 0) + p.numInputRows
            self.events.append((str(p.runId), "batch_completed", p.numInputRows))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.events.append((str(event.runId), "job_failed" if event.exception else "job_completed", 0))
