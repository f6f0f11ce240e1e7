"""What a follower of a project's progress sees: its events, a ping for every five minutes without one, and an end.

As a stream (`follow`) this is state with a timer for each project; as a batch (`followed`) it is one window over the same
events, which the stream is held against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds without an event before a ping, and the stages that end a stream (an error only of no chapter).
IDLE, ENDS = 300, ("complete", "error")
#: What the state needs: a store that keeps timers, and the rows that go to Python at a time.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "project string, at timestamp, kind string, event_id long"
#: What leaves the state: an event in one row, and the pings of one silence too, the first of them with their number.
RUNS = f"{OUT}, n long"


def ending(stage: Column, chapter: Column) -> Column:
    """Whether an event ends its project's stream."""
    return F.coalesce(stage.isin(*ENDS) & chapter.isNull(), F.lit(False))


def _timed(events: DataFrame) -> DataFrame:
    return events.select(F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project"), F.col("ts").cast("timestamp").alias("ts"), "event_id", ending(F.col("stage"), F.col("chapter_id")).alias("ends"))


def followed(events: DataFrame, until: Column | None = None, idle: int = IDLE) -> DataFrame:
    """(project, at, kind, event_id) of events (event_id, project, ts, stage, chapter_id): each event as `event`, or `end` if it
    ends its stream, and a `ping` every `idle` seconds after one that does not, before the next event of the project; after
    its last one up to `until` (none without). An event after an end begins a stream anew. Events of one time go by id;
    those without a time are left out. (S05)"""
    e = _timed(events).where("ts IS NOT NULL")
    order = W.partitionBy("project").orderBy("ts", "event_id")
    e = e.withColumn("next", F.lead("ts").over(order))
    micros = F.unix_micros
    before = F.when(F.col("next").isNotNull(), F.floor((micros("next") - micros("ts") - 1) / (idle * 1_000_000)))
    last = F.floor((micros(until) - micros("ts")) / (idle * 1_000_000)) if until is not None else F.lit(0)
    n = F.when(F.col("ends"), 0).otherwise(F.greatest(F.lit(0), F.coalesce(before, last))).cast("int")
    seen = e.select("project", F.col("ts").alias("at"), F.when(F.col("ends"), "end").otherwise("event").alias("kind"), "event_id")
    first = F.timestamp_micros(micros("ts") + F.lit(idle * 1_000_000))
    runs = e.withColumn("n", n).where("n > 0").select("project", first.alias("at"), F.lit("ping").alias("kind"), F.lit(None).cast("long").alias("event_id"), "n")
    return seen.union(_each(runs, idle))


def _each(runs: DataFrame, idle: int) -> DataFrame:
    """A row for each ping of runs (project, at, kind, event_id, n), `idle` seconds apart; events are runs of one."""
    at = F.timestamp_micros(F.unix_micros("at") + F.col("k") * idle * 1_000_000)
    return runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("n", F.lit(1)).cast("long") - 1))).select("project", at.alias("at"), "kind", "event_id")


class Follower(StatefulProcessor):
    """When a project's next ping is due, and the timer for it. At an end both go, so no state is left of a stream that is over."""

    def __init__(self, idle: int = IDLE):
        self.idle = idle * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "due long")

    def _wait(self, due: int | None) -> None:
        """The one timer of the project, if it waits for any."""
        if self.last.exists():
            if self.last.get()[0] == due:
                return
            self.handle.deleteTimer(self.last.get()[0])
        if due is None:
            self.last.clear()
        else:
            self.handle.registerTimer(due)
            self.last.update((due,))

    def _rows(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        at, kind, event_id, n = zip(*rows, strict=True)
        return pd.DataFrame({"project": key[0], "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="ms"), "kind": kind, "event_id": pd.array(event_id, "Int64"), "n": n})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Events in order; before each, the run of pings that fall due."""
        e = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        due, out = self.last.get()[0] if self.last.exists() else None, []
        for ts, event_id, ends in zip(e["ts"], e["event_id"], e["ends"], strict=True):
            millis = ts.value // 1_000_000
            if due is not None and due < millis:
                out.append((due, "ping", None, (millis - due - 1) // self.idle + 1))
            out.append((millis, "end" if ends else "event", event_id, 1))
            due = None if ends else millis + self.idle
        self._wait(due)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All pings that are due by now: a project may have been silent for long when the watermark moves."""
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        n = max(0, now - due) // self.idle + 1
        self._wait(due + n * self.idle)
        yield self._rows(key, [(due, "ping", None, n)])

    def close(self) -> None:
        pass


def _runs(events: DataFrame, late: str, idle: int) -> DataFrame:
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STORE}")
    timed = _timed(events).where("ts IS NOT NULL").withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    return timed.groupBy("project").transformWithStateInPandas(Follower(idle), RUNS, "Append", "EventTime")


def follow(events: DataFrame, late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """followed() over a stream of events. A timer goes off once the watermark, `late` behind the latest event of all
    projects, has passed it; events later than that are left out. Times are of milliseconds. (S05)"""
    return _each(_runs(events, late, idle), idle)


def replay(events: DataFrame, folder: str, late: str = "10 minutes", idle: int = IDLE) -> DataFrame:
    """What follow() makes of all events that a stream has now, written to a folder with its checkpoint, and read back. A
    second call with the same folder goes on where the first one ended. Silences are written as runs, which are as many as
    events however long they last, and become pings when they are read. (S05)"""
    spark: SparkSession = events.sparkSession
    query = _runs(events, late, idle).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return _each(spark.read.schema(RUNS).parquet(f"{folder}/rows"), idle)


# --- groups one after the other ----------------------------------------------------------------------------------------
def generation_groups(groups: DataFrame) -> DataFrame:
    """(project, pos, entry_summary, green, yellow, red, runs) of groups (project, pos, status, summary, paused, n_green, n_yellow,
    n_red, size): what each group of sections starts from and adds, when they run one after the other. A failed group
    (status `failed`) adds its size to the red ones and hands on nothing; a group of size 0 neither. The summary that a group
    starts from is that of the last one before it that ran and had chapters, even a null one; a paused group is the last
    that runs. (S09)

    The carried state is two running windows over the groups of a project."""
    before = W.partitionBy("project").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    stops = F.coalesce(F.col("paused") & ~failed, F.lit(False))
    g = groups.withColumn("_stopped", F.coalesce(F.max(stops.cast("int")).over(before), F.lit(0)) == 1)
    said = F.when(~failed & (F.col("size") > 0), F.struct(F.col("summary").alias("s")))
    g = g.withColumn("entry_summary", F.last(said, ignorenulls=True).over(before)["s"])
    number = lambda name, of_failed: F.when(F.col("_stopped"), 0).when(failed, of_failed).otherwise(F.coalesce(name, F.lit(0))).cast("long")
    return g.select("project", "pos", F.when(~F.col("_stopped"), F.col("entry_summary")).alias("entry_summary"), number("n_green", F.lit(0)).alias("green"), number("n_yellow", F.lit(0)).alias("yellow"), number("n_red", F.col("size")).alias("red"), (~F.col("_stopped")).alias("runs"))
