"""A stream of shuffled, late and repeated events against the batch, and a stalled run."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from corpusloom.streaming import runs as R

SCHEMA = "run_id string, section_id string, seq long, type string, ts timestamp"


def events():
    rng, out = random.Random(6), []
    for run in range(5):
        for seq in range(60):
            kind = rng.choice([R.START, R.DONE, R.FAILED] if run else [R.START, R.DONE])
            out.append((f"r{run}", f"s{rng.randrange(8)}", seq, kind, datetime(2024, 1, 1) + timedelta(minutes=seq if run != 3 else seq / 10)))
    return out


def test_stream_equals_batch_and_reports_what_stalled(spark, tmp_path):
    rows = events()
    rng = random.Random(7)
    batches = [[r for r in rows if lo <= r[4].minute + 60 * r[4].hour < lo + 12] for lo in range(0, 60, 12)]
    for k, batch in enumerate(batches):
        more = rng.sample(batches[k - 1], 6) if k else []  # late and repeated ones
        mixed = batch + more + rng.sample(batch, 10)
        rng.shuffle(mixed)
        spark.createDataFrame(mixed, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen: dict = {}
    stalled = set()

    def keep(df, _):
        for r in df.collect():
            seen[r["run_id"]] = r
            stalled.update({r["run_id"]} if r["stalled"] else ())

    stream = R.stream_runs(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), stall_minutes=20, late="15 minutes")
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination(240)
    assert query.exception() is None
    batch = {r["run_id"]: r for r in R.run_progress(spark.createDataFrame(rows, SCHEMA), "20 minutes", "2024-01-01 00:44:00").collect()}
    assert stalled == {"r3"} == {k for k, r in batch.items() if r["stalled"]}
    assert {k: tuple(r) for k, r in seen.items()} == {k: tuple(r) for k, r in batch.items()}
    assert batch["r0"]["stopped_at"] is None and any(r["stopped_at"] is not None for r in batch.values())
