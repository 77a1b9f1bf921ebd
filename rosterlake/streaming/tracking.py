"""Processing state of each key as a stateful stream: latest status, steps done, failure, and expiry after silence.

Events of a key belong to one run of work as long as no pause between them is longer than
ttl; the run expires when that much time has passed after its last event.  Events may
come out of order within the delay: an event joins the runs that it is near to, and may
join two to one.  A run is let go only when the watermark says that nothing can be added to
it.  So the stream says the same as its batch twin, runs(), over the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rosterlake.streaming.state import FAILED, STEPS, progress

HOUR = 3_600_000_000
STEP = "array<struct<status string, at bigint>>"


class Tracker(StatefulProcessor):
    """List state: the open runs of a key; value state: the time of its one timer.  Times are microseconds."""

    def __init__(self, key: str, ttl_hours: int, known: tuple[str, ...]):
        self.key, self.ttl, self.known = key, ttl_hours * HOUR, known

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Few: what is older than the delay and ttl together has expired.
        self.open = handle.getListState("runs", f"first bigint, last bigint, turn bigint, status string, steps {STEP}")
        self.timer = handle.getValueState("timer", "at bigint")

    def _runs(self) -> list[tuple]:
        return [(r[0], r[1], r[2], r[3], {s[0]: s[1] for s in r[4]}) for r in self.open.get()] if self.open.exists() else []

    def _keep(self, runs: list[tuple]) -> None:
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if not runs:
            self.open.clear()
            return
        self.open.put([(a, b, t, s, sorted(steps.items())) for a, b, t, s, steps in runs])
        at = -(-(min(r[1] for r in runs) + self.ttl) // 1000)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def _joined(self, runs: list[tuple], new: tuple) -> list[tuple]:
        apart = []
        for run in runs:
            if run[0] - self.ttl <= new[1] and new[0] <= run[1] + self.ttl:
                later = max(run, new, key=lambda r: (r[1], r[2]))
                steps = {k: min(x[4][k] for x in (run, new) if k in x[4]) for k in run[4] | new[4]}
                new = (min(run[0], new[0]), *later[1:4], steps)
            else:
                apart.append(run)
        return [*apart, new]

    def _told(self, key, run: tuple, expired: bool) -> Row:
        steps = [Row(status=s, at=at) for s, at in sorted(run[4].items(), key=lambda x: (x[1], x[0]))]
        return Row(**{self.key: key[0], "status": run[3], "updated": run[1], "started": run[0], "steps": steps, "expired": expired})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        runs = self._runs()
        for r in rows:
            runs = self._joined(runs, (r.at, r.at, r.turn, r.status, {r.status: r.at} if r.status in self.known else {}))
        self._keep(runs)
        yield self._told(key, max(runs, key=lambda r: r[1]), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        now = timerValues.getCurrentWatermarkInMs() * 1000
        runs = self._runs()
        for run in sorted(runs):
            if run[1] + self.ttl <= now:
                yield self._told(key, run, True)
        self._keep([r for r in runs if r[1] + self.ttl > now])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802
        s = initialState
        self._keep(self._joined(self._runs(), (s.first, s.last, s.turn, s.status, {x["status"]: x["at"] for x in s.steps})))

    def close(self) -> None:
        pass


def prepare(spark: SparkSession) -> None:
    """State of this kind needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def told(rows: DataFrame, key: str) -> DataFrame:
    """Times as timestamps, and the progress of the status."""
    steps = F.transform("steps", lambda s: F.struct(s["status"].alias("status"), F.timestamp_micros(s["at"]).alias("at")))
    percent = progress(F.col("status")).alias("percent")
    return rows.select(key, "status", F.timestamp_micros("updated").alias("updated"), F.timestamp_micros("started").alias("started"), percent, steps.alias("steps"), "expired")


def track(events: DataFrame, key: str, status: str, stamp: str, order: str, ttl_hours: int, delay: str, known: tuple[str, ...] = (*STEPS, FAILED), initial: DataFrame | None = None) -> DataFrame:
    """A streaming frame in update mode: key, status, updated, started, percent, steps, expired.

    For each batch a row for each key that had events, of its latest run, and a row with
    expired for each run that the watermark (delay behind the latest event) has passed by
    ttl_hours.  steps: the known statuses that the run had and when first; another status
    counts as the latest one but is no step.  order breaks ties of time.  Events without a
    key or a time are left out.  initial: what the state begins with, as open_runs() gives it.
    """
    # Whole milliseconds, as timers and watermarks have them.
    at = F.floor(F.unix_micros(F.col(stamp).cast("timestamp")) / 1000) * 1000
    rows = events.where(F.col(key).isNotNull() & F.col(stamp).isNotNull()).select(
        F.col(key), F.coalesce(F.col(status), F.lit("")).alias("status"), at.cast("long").alias("at"), F.col(order).cast("long").alias("turn"), F.timestamp_micros(at.cast("long")).alias("event_time")
    )
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, status string, updated bigint, started bigint, steps {STEP}, expired boolean"
    grouped = rows.withWatermark("event_time", delay).groupBy(key)
    first = None if initial is None else initial.groupBy(key)
    return told(grouped.transformWithState(Tracker(key, ttl_hours, known), schema, "Update", "EventTime", initialState=first), key)


def runs(events: DataFrame, key: str, status: str, stamp: str, order: str, ttl_hours: int, as_of, known: tuple[str, ...] = (*STEPS, FAILED)) -> DataFrame:
    """The batch twin: a row for every run, expired where ttl_hours have passed at as_of since its last event."""
    at = (F.floor(F.unix_micros(F.col(stamp).cast("timestamp")) / 1000) * 1000).cast("long")
    rows = events.where(F.col(key).isNotNull() & F.col(stamp).isNotNull()).select(F.col(key), F.coalesce(F.col(status), F.lit("")).alias("status"), at.alias("at"), F.col(order).cast("long").alias("turn"))
    before = Window.partitionBy(key).orderBy("at", "turn")
    begins = F.coalesce(F.col("at") - F.lag("at").over(before) > ttl_hours * HOUR, F.lit(True))
    numbered = rows.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(before))
    # Of each run and status the first time, then of each run a row: no list holds more than the statuses.
    each = numbered.groupBy(key, "run", "status").agg(F.min("at").alias("first"), F.max(F.struct("at", "turn")).alias("last"))
    step = F.when(F.col("status").isin(*known), F.struct(F.col("first").alias("at"), "status"))
    found = each.groupBy(key, "run").agg(F.max(F.struct("last.at", "last.turn", "status")).alias("l"), F.min("first").alias("started"), F.sort_array(F.collect_list(step)).alias("steps"))
    steps = F.transform("steps", lambda s: F.struct(s["status"].alias("status"), s["at"].alias("at")))
    expired = F.col("l.at") + ttl_hours * HOUR <= F.unix_micros(F.lit(as_of).cast("timestamp"))
    return found.select(key, "l.status", F.col("l.at").alias("updated"), "started", steps.alias("steps"), expired.alias("expired"), F.col("l.turn").alias("turn"))


def open_runs(found: DataFrame, key: str) -> DataFrame:
    """Of runs() those that have not expired, as a stream begins with them."""
    return found.where("not expired").select(key, F.col("started").alias("first"), F.col("updated").alias("last"), "turn", "status", "steps")
