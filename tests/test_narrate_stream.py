"""Narration as a stream of runs: each request is sent once, and names the parts of its own run around it."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

import pytest
from corpusloom.narrate import pipeline as N
from corpusloom.queries import tours

from tests.test_declared_entries import nodes


@dataclass
class Counted:
    """Leaves a file for each request."""

    folder: str

    def __call__(self, system, prompt, max_tokens):
        open(f"{self.folder}/{prompt.split(chr(10), 1)[0].removeprefix('Part: ')}-{os.getpid()}-{time.monotonic_ns()}", "w").close()
        return tours.FixedWriter.__call__(self, system, prompt, max_tokens)


def test_walkthroughs_ask_once(spark, tmp_path, monkeypatch):
    asked = tmp_path / "asked"
    asked.mkdir()
    spark.createDataFrame([(c, t, "user", "Words.") for c in range(3) for t in range(5)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(tours, "FixedWriter", lambda: Counted(str(asked)))
    df = tours.n9_walkthroughs(spark, str(tmp_path))
    rows = df.collect()
    assert {(r["conv"], r["n_parts"], r["missing"]) for r in rows} == {(f"o|r{c}", 4, "part3") for c in range(3)} and len(rows) == 3
    names = sorted(x.split("-")[0] for x in os.listdir(asked))
    broadcast = " ".join(str(x.output()) for x in nodes(df._jdf.queryExecution().executedPlan()) if x.getClass().getSimpleName() == "BroadcastExchangeExec")
    assert not any(text in broadcast for text in ("body", "overview", "chapters")), broadcast
    assert names == sorted(3 * ["Overview", "Closing", *(f"part{t}" for t in range(5))])


@dataclass
class Around:
    """Tells what a request says of the parts around its own."""

    def __call__(self, system, prompt, max_tokens):
        rows = prompt.split("\n")
        return "TITLE: T\n" + " ".join(x for x in rows if x.startswith(("Part: ", "Before this", "After this")))


@pytest.mark.parametrize("concurrency", [1, 2, 3])
def test_runs_end_anywhere_in_a_batch(spark, concurrency):
    sizes = {f"r{k:02}": n for k, n in enumerate((1, 2, 3, 4, 5, 7, 130, 64, 1, 65))} | {None: 3}
    rows = [(run, f"s{i}", i, f"{run}p{i}", ["x"], 1, 2) for run, n in sizes.items() for i in reversed(range(n))]
    df = spark.createDataFrame(rows, "run_key string, section_id string, ord int, label string, chunks array<string>, lo int, hi int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        out = N.narrate(df, Around(), slots=2, concurrency=concurrency).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(out) == len(rows)
    for r in out:
        run, i, n = r["run_key"], r["ord"], sizes[r["run_key"]]
        after = ", ".join(f"{run}p{j}" for j in range(i + 1, min(i + 3, n))) or "nothing"
        assert r["body"] == f"Part: {run}p{i} Before this: {f'{run}p{i - 1}' if i else 'nothing'}. After this: {after}."


def test_a_slot_keeps_its_pace_over_runs(spark, tmp_path):
    def sleep(seconds):
        open(f"{tmp_path}/{os.getpid()}-{time.monotonic_ns()}", "w").close()

    df = spark.createDataFrame([(f"r{k}", "s0", 0, "p0", ["x"], 1, 2) for k in range(4)], "run_key string, section_id string, ord int, label string, chunks array<string>, lo int, hi int")
    assert len(N.narrate(df, Around(), sleep=sleep, slots=1, per_minute=1).collect()) == 4
    assert len(os.listdir(tmp_path)) == 3
