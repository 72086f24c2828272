"""Runs as they go: one stateful stream per run with its progress, the breaker of three failures in a row, and a timer that
reports a run from which nothing has come for a while.

Events are (run_id, section_id, seq, type, ts); seq orders the events of a run, and an event that comes twice has the same
seq. State is keyed by run and holds each seq's event; it takes them in any order, so late and
repeated ones end in the same state as a batch over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

RUNS = "run_id string, n_sections long, n_start long, n_done long, n_failed long, n_events long, last_seq long, stopped_at long, stalled boolean"
NAMES = [c.split(" ")[0] for c in RUNS.split(", ")]
START, DONE, FAILED = "section-start", "section-done", "section-failed"
IN_A_ROW = 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_progress(events: DataFrame, stall: str = "30 minutes", now: str | None = None) -> DataFrame:
    """A14, W10, N12 in batch: RUNS rows. stopped_at: the seq of the third failure in a row; stalled: whether `stall` has passed
    since the run's last event at the time `now` (null: not judged)."""
    once = events.groupBy("run_id", "seq").agg(F.max(F.struct("type", "section_id", "ts")).alias("e")).select("run_id", "seq", "e.*")
    latest = once.groupBy("run_id", "section_id").agg(F.max(F.struct("seq", "type")).alias("m"))
    of = lambda kind: F.sum((F.col("m.type") == kind).cast("int")).cast("long")
    counts = latest.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_sections"), of(START).alias("n_start"), of(DONE).alias("n_done"), of(FAILED).alias("n_failed"))
    judged = once.filter(F.col("type").isin(DONE, FAILED))
    last = Window.partitionBy("run_id").orderBy("seq").rowsBetween(1 - IN_A_ROW, 0)
    run = judged.withColumn("k", F.sum((F.col("type") == FAILED).cast("int")).over(last)).filter(F.col("k") == IN_A_ROW)
    stopped = run.groupBy("run_id").agg(F.min("seq").alias("stopped_at"))
    whole = once.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("seq").alias("last_seq"), F.max("ts").alias("last"))
    stalled = F.lit(False) if now is None else F.col("last") + F.expr(f"INTERVAL {stall}") < F.lit(now).cast("timestamp")
    return counts.join(whole, "run_id").join(stopped, "run_id", "left").withColumn("stalled", stalled).select(*NAMES)


class RunProcessor(StatefulProcessor):
    def __init__(self, stall_ms: int):
        self.stall_ms = stall_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getMapState("events", "seq long", "type string, section_id string")
        self.last = handle.getValueState("last", "ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = self.last.get()[0] if self.last.exists() else -1
        for pdf in rows:
            for section, seq, kind, ts in zip(pdf["section_id"], pdf["seq"], pdf["type"], pdf["ts"], strict=True):
                seq = int(seq)
                known = self.events.getValue((seq,)) if self.events.containsKey((seq,)) else ("", "")
                if (kind, section) > tuple(known):  # of two events of one seq the greater counts, as in batch
                    self.events.updateValue((seq,), (kind, section))
                newest = max(newest, int(ts.value // 1_000_000))
        self.last.update((newest,))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(newest + self.stall_ms)
        yield self._row(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, True)

    def _row(self, key, stalled: bool) -> pd.DataFrame:
        events = sorted((k[0], v[0], v[1]) for k, v in self.events.iterator())
        latest = {section: kind for _, kind, section in events}
        stopped, failures = None, 0
        for seq, kind, _ in events:
            failures = failures + 1 if kind == FAILED else 0 if kind == DONE else failures
            if failures == IN_A_ROW:
                stopped = seq
                break
        kinds = list(latest.values())
        row = [key[0], len(latest), kinds.count(START), kinds.count(DONE), kinds.count(FAILED), len(events), events[-1][0], stopped, stalled]
        return pd.DataFrame([row], columns=NAMES).astype({"stopped_at": "Int64"})

    def close(self) -> None:
        pass


def stream_runs(events: DataFrame, stall_minutes: int = 30, late: str = "10 minutes") -> DataFrame:
    """N12, A14, W10 over a stream: a RUNS row for each run that a batch touches, and one with `stalled` once the watermark has
    passed its last event by stall_minutes; further events make it go on. The session keeps state in RocksDB, as timers ask."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    keyed = events.withWatermark("ts", late).groupBy("run_id")
    return keyed.transformWithStateInPandas(RunProcessor(stall_minutes * 60_000), RUNS, "Update", "EventTime")
