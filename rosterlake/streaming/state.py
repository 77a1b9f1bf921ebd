"""Processing state as a stream of events: latest state per key, intake once, expiry, monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STEPS = ("view", "click", "signup", "purchase")
FAILED = "error"


def latest_state(events: DataFrame, key: str, status: str, stamp: str, order: str) -> DataFrame:
    """key, status, updated: the last event of each key; works on batches and streams (update or complete mode)."""
    last = F.max_by(F.struct(F.col(status).alias("status"), F.col(stamp).alias("updated")), F.struct(stamp, order))
    return events.groupBy(key).agg(last.alias("last")).select(key, "last.status", "last.updated")


def progress(status: Column, steps: tuple[str, ...] = STEPS, failed: str = FAILED) -> Column:
    """Percent of the ordered steps done; 0 for the failure state and unknown states."""
    place = F.array_position(F.array(*[F.lit(s) for s in steps]), status)
    return F.when(status == failed, 0).otherwise((F.coalesce(place, F.lit(0)) * 100 / len(steps)).cast("int"))


def alive(rows: DataFrame, stamp: str, as_of: str, hours: int) -> DataFrame:
    """Rows not older than so many hours at as_of."""
    return rows.where(F.col(stamp) >= F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {hours} HOURS"))


def once(events: DataFrame, key: str, stamp: str, delay: str) -> DataFrame:
    """The first row of each key that arrives within the delay; for streams."""
    return events.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def monitor(events: DataFrame, status: str, stamp: str, width: str) -> DataFrame:
    """Rows by status and tumbling window."""
    counted = events.groupBy(F.col(status).alias("status"), F.window(stamp, width)).agg(F.count("*").alias("n"))
    return counted.select("status", F.col("window.start").alias("window_start"), "n")
