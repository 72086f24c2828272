"""The state of runs from their events: as a batch fold, and as a streaming job with the same rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "run_id string, section_id string, status string, seq long, n_events long"


def latest_states(events: DataFrame) -> DataFrame:
    """(run_id, section_id, status, seq, n_events) from events (run_id, section_id, seq, type); ties in seq go to the later type by name."""
    picked = events.groupBy("run_id", "section_id").agg(F.max(F.struct("seq", "type")).alias("m"), F.count(F.lit(1)).alias("n_events"))
    return picked.select("run_id", "section_id", F.col("m.type").alias("status"), F.col("m.seq").alias("seq"), "n_events")


def progress(states: DataFrame) -> DataFrame:
    """Per run, counts by status."""
    return states.groupBy("run_id").agg(*[F.sum((F.col("status") == s).cast("int")).alias(f"n_{s.replace('-', '_')}") for s in ("section-start", "section-done", "section-failed")], F.count(F.lit(1)).alias("n_sections"))


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seq, status, n = state.get if state.exists else (-1, "", 0)
    for pdf in batches:
        n += len(pdf)
        for s, t in zip(pdf["seq"], pdf["type"], strict=True):
            if (s, t) > (seq, status):
                seq, status = int(s), t
    state.update((seq, status, n))
    yield pd.DataFrame([{"run_id": key[0], "section_id": key[1], "status": status, "seq": seq, "n_events": n}])


def stream_states(events: DataFrame) -> DataFrame:
    """N12 over a stream: every batch yields the new state of the sections it touches; late and repeated order make no difference."""
    keyed = events.groupBy("run_id", "section_id")
    return keyed.applyInPandasWithState(_fold, STATE, "seq long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Events by type in windows of time, with late ones up to a limit."""
    return events.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "type", "n")
