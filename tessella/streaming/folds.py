"""Structured Streaming forms of the event folds: usage counts, job progress, and a cache with a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.sessions import STAGE_PROGRESS


def event_stream(spark, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def usage_counts(events: DataFrame, session: str = "user_id", tool: str = "event_type") -> DataFrame:
    """Running counts per session and tool (output modes complete and update)."""
    return events.groupBy(F.col(session).alias("session"), F.col(tool).alias("tool")).agg(F.count("*").alias("calls"))


def windowed_counts(events: DataFrame, ts: str, tool: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts per tumbling window and tool; events later than `late` behind the newest are left out and state ends there."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(tool).alias("tool")).agg(F.count("*").alias("calls")).select(
        F.col("w.start").alias("start"), "tool", "calls"
    )


def document_progress(events: DataFrame) -> DataFrame:
    """Per (job, doc) the progress so far: a running maximum, which never falls however events arrive."""
    level = F.create_map(*[F.lit(x) for pair in STAGE_PROGRESS.items() for x in pair])
    return events.groupBy("job", "doc").agg(F.max(F.coalesce(F.try_element_at(level, "stage"), F.lit(0))).alias("progress"))


def first_in_window(requests: DataFrame, ts: str, key: str, ttl: str = "1 hour") -> DataFrame:
    """Requests that a cache with this time limit hasn't seen: the first of each key within the watermark."""
    requests = requests.withColumn(ts, F.col(ts).cast("timestamp"))  # a watermark needs a time zone
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])
