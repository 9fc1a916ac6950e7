"""Streams of events (an extension: the batch operators have no stream form of their own).

Windows close by watermark, so state is bounded by the lateness allowed; what arrives later is dropped by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_rates(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 day", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """start, kind, n, total, mean per window; tumbling, or sliding with ``slide``. Works on batches and streams."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_ts", late) if events.isStreaming else stamped
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    rows = stamped.groupBy(w.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return rows.select(F.col("w.start").alias("start"), "kind", "n", "total", "mean")


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end, n of runs of events without a longer pause."""
    stamped = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    stamped = stamped.withWatermark("_ts", late) if events.isStreaming else stamped
    rows = stamped.groupBy(F.session_window("_ts", gap).alias("w"), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return rows.select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def quality_stream(stream: DataFrame, check: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs a quality aggregate on every batch and appends its rows, with the batch's number, to a table of files. A batch
    that is run again overwrites its own rows."""
    def one(batch: DataFrame, number: int) -> None:
        check(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
