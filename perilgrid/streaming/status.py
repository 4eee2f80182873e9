"""Status events as a stream: the latest state of each case, upserted by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from perilgrid.operators.cases import checked_events


def latest_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The latest status of each case from a stream of events (inspection_id, changed_at, id, to_status). State is kept by
    case; rows that are later than the watermark, or repeated, change nothing."""
    known = checked_events(events).withWatermark("changed_at", late)
    last = known.groupBy("inspection_id").agg(F.max(F.struct("changed_at", "id", "to_status")).alias("last"))
    return last.select("inspection_id", F.col("last.to_status").alias("status"), "last.changed_at")


def changes_by_window(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """Changes by tumbling window and status; a window is given out once, after the watermark has passed it."""
    known = events.withWatermark("changed_at", late)
    return known.groupBy(F.window("changed_at", size), "to_status").agg(F.count("*").alias("n"))


def append_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to the event table of a case store, exactly once."""
    return checked_events(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
