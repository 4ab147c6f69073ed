"""Trailing volumes from daily panes, and latest marks that go stale by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

MARKED = "n long, low double, high double, usd double, event_id long, marked long"
KEYED = "gpu_class int, kind string, source string"


@contextmanager
def settings(spark: SparkSession, **held: str):
    """Streams started inside run with these settings of the session, dots for underscores; afterwards it has its own again."""
    before = {k: spark.conf.get(k, None) for k in (name.replace("_", ".") for name in held)}
    for name, x in held.items():
        spark.conf.set(name.replace("_", "."), x)
    try:
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def keyed_state(spark: SparkSession):
    """State in RocksDB, which values with timers need."""
    return settings(spark, spark_sql_streaming_stateStore_providerClass=_ROCKS)


def many_windows(spark: SparkSession):
    """No fused code: what deals a pane to 180 windows is more than one compiled method holds, and panes are few."""
    return settings(spark, spark_sql_codegen_wholeStage="false")


def trailing_volume(rows: DataFrame, key: str, days: int = 180, delay: str = "1 day") -> DataFrame:
    """key, day, n, behind of each day that the watermark has passed: its rows, and those of the `days` days that end with it.

    Rows are counted into daily panes first; only panes are dealt to the windows that slide over them, a row a key and day in
    place of one an event, so neither the windows' input nor what comes out outgrows keys times days. A day without rows has
    n = 0 where one of the days before it has some. Rows later than the watermark, `delay` behind the latest, are dropped.
    """
    panes = rows.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), key).agg(F.count("*").alias("n"))
    slid = panes.groupBy(F.window("window", f"{days} days", "1 day").alias("span"), key)
    slid = slid.agg(F.sum("n").alias("behind"), F.max(F.struct(F.col("window.end").alias("end"), "n")).alias("last"))
    own = F.when(F.col("last.end") == F.col("span.end"), F.col("last.n")).otherwise(F.lit(0).cast("long"))
    return slid.select(key, F.date_sub(F.to_date("span.end"), 1).alias("day"), own.alias("n"), "behind")


class _Marks(StatefulProcessor):
    """One value a key: its count, extremes, latest mark, and how often it was told; a timer tells it once more as stale."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", f"{MARKED}, told long, due long")

    def _told(self, key: tuple, held: tuple, stale: bool) -> Row:
        *mark, told, _ = held
        return Row(gpu_class=key[0], kind=key[1], source=key[2], n=mark[0], low=mark[1], high=mark[2], usd=mark[3], event_id=mark[4], marked=mark[5], stale=stale, told=told)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, low, high, usd, event_id, marked, told, due = self.mark.get() if self.mark.exists() else (0, None, None, None, None, None, 0, None)
        for r in rows:
            n += 1
            if r.usd is not None:
                low, high = (r.usd if low is None else min(low, r.usd)), (r.usd if high is None else max(high, r.usd))
            if marked is None or (r.at, r.event_id) > (marked, event_id):
                usd, event_id, marked = r.usd, r.event_id, r.at
        if due is not None:
            self.handle.deleteTimer(due)
        due = marked // 1000 + self.ttl_ms
        self.handle.registerTimer(due)
        held = (n, low, high, usd, event_id, marked, told + 1, due)
        self.mark.update(held)
        yield self._told(key, held, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *rest, told, _ = self.mark.get()
        held = (*rest, told + 1, None)
        self.mark.update(held)
        yield self._told(key, held, True)

    def close(self) -> None:
        pass


def latest_marks(ticks: DataFrame, ttl_hours: float = 24.0, delay: str = "1 hour") -> DataFrame:
    """What each class, kind and source is worth as ticks (gpu_class, kind, source, ts, event_id, usd) come in.

    A row whenever that changes: n, low and high of all ticks so far, the latest (of one time that with the greatest
    event_id), and stale, which a timer sets once the watermark is ttl_hours past it and the next tick takes back. `told`
    numbers the rows of a key; the last counts. State is one value a key. The ticks of a key in a micro-batch pass one task
    one by one, gathered nowhere. Ticks later than the watermark that their
    micro-batch is judged by are dropped; a null price counts, and can be the latest,
    but is neither low nor high.
    """
    # Times go in and out as microseconds, which no time zone shifts.
    held = ticks.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).groupBy("gpu_class", "kind", "source")
    told = held.transformWithState(_Marks(int(ttl_hours * 3_600_000)), f"{KEYED}, {MARKED}, stale boolean, told long", "update", "eventTime")
    return told.withColumn("marked", F.timestamp_micros("marked"))


def last_told(told: DataFrame) -> DataFrame:
    """Of what latest_marks has told the last row of each key."""
    keys = ["gpu_class", "kind", "source"]
    rest = [c for c in told.columns if c not in (*keys, "told")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "told").alias("r")).select(*keys, "r.*")
