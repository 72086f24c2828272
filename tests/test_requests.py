"""Requests: slots, waves, pace, learned parameters, errors as rows, siblings."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field, replace

import pytest
from corpusloom.narrate import pipeline as N
from corpusloom.narrate import requests as R


@dataclass
class CountingWriter:
    """Leaves a file for each request under way, and notes how many there are."""

    folder: str

    def __call__(self, system, prompt, max_tokens):
        mine = f"{self.folder}/now-{os.getpid()}-{time.monotonic_ns()}"
        open(mine, "w").close()
        here = sum(name.startswith("now-") for name in os.listdir(self.folder))
        open(f"{self.folder}/seen-{here}-{os.getpid()}-{time.monotonic_ns()}", "w").close()
        time.sleep(0.05)
        os.remove(mine)
        label = prompt.split("\n", 1)[0].removeprefix("Part: ")
        return f"TITLE: {label}\nBody of {label}.\nFACTS: - fact of {label}"


def runs(spark, n=12, parts=4):
    rows = [(f"r{i}", f"s{k}", k, f"p{k}", ["x"], 50, 90) for i in range(n) for k in range(parts)]
    return spark.createDataFrame(rows, "run_key string, section_id string, ord int, label string, chunks array<string>, lo int, hi int").repartition(8)


@pytest.mark.parametrize(("slots", "concurrency"), [(2, 1), (1, 3)])
def test_requests_under_way_are_bounded(spark, tmp_path, slots, concurrency):
    out = N.narrate(runs(spark), CountingWriter(str(tmp_path)), slots=slots, concurrency=concurrency).collect()
    assert len(out) == 48 and {r["status"] for r in out} == {"done"}
    most = max(int(name.split("-")[1]) for name in os.listdir(tmp_path) if name.startswith("seen-"))
    assert 1 <= most <= slots * concurrency
    assert N.dealt(runs(spark), 5).rdd.getNumPartitions() == 5


@dataclass
class Echo:
    """Tells which facts a request knows of; fails where it is told to."""

    bad: dict = field(default_factory=dict)

    def __call__(self, system, prompt, max_tokens):
        label = prompt.split("\n", 1)[0].removeprefix("Part: ")
        if label in self.bad:
            raise self.bad[label]
        known = sorted({w for w in prompt.replace(".", " ").split() if w.startswith("fact")})
        return f"TITLE: {label}\nKnows {' '.join(known) or 'nothing'}.\nFACTS: - fact{label}"


@pytest.mark.parametrize("concurrency", [1, 2, 3])
def test_waves_know_what_the_waves_before_established(spark, concurrency):
    out = sorted(N.narrate(runs(spark, 1, 6), Echo(), concurrency=concurrency).collect(), key=lambda r: r["ord"])
    for r in out:
        known = [f"factp{k}" for k in range(r["ord"] // concurrency * concurrency)]
        assert r["body"] == f"Knows {' '.join(known) or 'nothing'}."


def test_failures_stop_a_run_and_no_other(spark):
    # a fatal failure, one that is no WriterError at all, and three in a row
    writer = Echo({"p1": N.WriterError("other"), "boom": ValueError("odd"), "key": N.WriterError("auth")})
    rows = [("a", "s0", 0, "p0"), ("a", "s1", 1, "key"), ("a", "s2", 2, "p2"), ("b", "s0", 0, "p0"), ("b", "s1", 1, "boom"), ("b", "s2", 2, "p2"), ("c", "s0", 0, "p1"), ("c", "s1", 1, "p1"), ("c", "s2", 2, "p1"), ("c", "s3", 3, "p0")]
    df = spark.createDataFrame([(*r, ["x"], 1, 2) for r in rows], "run_key string, section_id string, ord int, label string, chunks array<string>, lo int, hi int")
    out = N.narrate(df, writer, sleep=lambda s: None, concurrency=2)
    got = {(r["run_key"], r["ord"]): (r["status"], r["error"]) for r in out.collect()}
    assert got == {
        ("a", 0): ("done", None), ("a", 1): ("failed", "auth"), ("a", 2): ("skipped", "auth"), ("b", 0): ("done", None), ("b", 1): ("failed", "server"), ("b", 2): ("done", None),
        ("c", 0): ("failed", "other"), ("c", 1): ("failed", "other"), ("c", 2): ("failed", "other"), ("c", 3): ("skipped", "other"),
    }
    assert {tuple(r) for r in N.narration_errors(out).collect()} == {("a", "narrate", "auth"), ("c", "narrate", "other")}


def test_one_tour_without_frame_leaves_the_others(spark):
    @dataclass
    class Framing:
        def __call__(self, system, prompt, max_tokens):
            if "bad run" in prompt:
                raise N.WriterError("auth")
            if "half run" in prompt and prompt.startswith("Part: Closing"):
                raise ValueError("odd")
            return "The end." if prompt.startswith("Part: Closing") else "NAME: Demo\nAll.\nCHAPTER 1: One"

    schema = N.RESULTS
    rows = [(run, "s0", 0, "done", None, title, "Body.", "Sum.", [], [], [], [], []) for run, title in (("a", "bad run"), ("b", "good run"), ("c", "half run"))]
    results = spark.createDataFrame(rows, schema)
    frames = N.frame_tours(results, Framing(), sleep=lambda s: None)
    got = {r["run_key"]: (r["name"], r["overview"], r["closing"], r["error"]) for r in frames.collect()}
    assert got == {"a": (None, None, None, "auth"), "b": ("Demo", "All.", "The end.", None), "c": ("Demo", "All.", None, "server")}
    assert {tuple(r) for r in N.narration_errors(results, frames).collect()} == {("a", "frame", "auth"), ("c", "frame", "server")}


@dataclass(frozen=True)
class Picky:
    """Accepts neither max_tokens nor a temperature, and leaves a file for each refusal."""

    folder: str
    parameters: R.Parameters = R.Parameters()

    def with_parameters(self, parameters):
        return replace(self, parameters=parameters)

    def __call__(self, system, prompt, max_tokens):
        if self.parameters.token_name == "max_tokens":
            open(f"{self.folder}/tokens-{os.getpid()}-{time.monotonic_ns()}", "w").close()
            raise N.WriterError("bad_request", "Unsupported parameter: 'max_tokens'. Use 'max_completion_tokens' instead.")
        if self.parameters.temperature:
            open(f"{self.folder}/heat-{os.getpid()}-{time.monotonic_ns()}", "w").close()
            raise N.WriterError("bad_request", "temperature does not support 0.7")
        return "TITLE: T\nBody."


def test_refused_parameters_are_learned_once_for_all_tasks(spark, tmp_path):
    refused = lambda: sorted(name.split("-")[0] for name in os.listdir(tmp_path))
    known = R.negotiated(spark, Picky(str(tmp_path)))
    assert known.parameters == R.Parameters("max_completion_tokens", False) and refused() == ["heat", "tokens"]
    out = N.narrate(runs(spark), known, slots=4).collect()
    assert {r["status"] for r in out} == {"done"} and refused() == ["heat", "tokens"]
    # without a probe each run learns for itself
    assert {r["status"] for r in N.narrate(runs(spark, 3), Picky(str(tmp_path)), slots=2).collect()} == {"done"} and len(refused()) == 8


@pytest.mark.parametrize(
    ("sent", "said", "want"),
    [
        (R.Parameters(), "max_tokens is not supported with this model", R.Parameters("max_completion_tokens")),
        (R.Parameters(), "use max_completion_tokens, not max_tokens", R.Parameters("max_completion_tokens")),
        (R.Parameters("max_completion_tokens"), "unknown argument max_completion_tokens", R.Parameters("none")),
        (R.Parameters("max_completion_tokens"), "max_completion_tokens and 'max_tokens' together", None),
        (R.Parameters(), "Temperature must be 1", R.Parameters(temperature=False)),
        (R.Parameters(temperature=False), "temperature must be 1", None),
        (R.Parameters("none", False), "max_tokens unsupported", None),
        (R.Parameters(), "no such model", None),
    ],
)
def test_what_a_refusal_teaches(sent, said, want):
    assert R.learned(sent, said) == want


def test_pace_keeps_requests_apart():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = R.Pace(60, 2, clock=lambda: now[0], sleep=sleep)
    for _ in range(4):
        pace()
    assert slept == [2.0, 2.0, 2.0]
    now[0] += 10
    pace()
    assert len(slept) == 3
    R.Pace(None, 2, sleep=sleep)()


def test_group_requests_and_siblings_in_revisions(spark):
    assert "These files go together" in N.part_prompt("g", "x", N.Ledger(), None, [], 1, 2, kind="group") and "Files:" in N.part_prompt("g", "x", N.Ledger(), None, [], 1, 2, kind="group")
    sections = spark.createDataFrame([("r", f"s{k}", k, [f"f{k}"]) for k in range(4)], "run_key string, section_id string, ord int, paths array<string>")
    names = {"f0": "abcde", "f1": "abc", "f2": "abcxyzuvw", "f3": "dex"}
    rare = spark.createDataFrame([("r", n, p, 2) for p, ns in names.items() for n in ns], "repo_id string, name string, path string, holders int")
    pairs = N.section_siblings(sections, rare)
    # s2 shares three names with s0 (five) and s1 (three): the earlier one; s3 shares two at most
    assert {(r["section_id"], r["sibling"]) for r in pairs.collect()} == {("s1", "s0"), ("s2", "s0")}
    results = N.narrate(runs(spark, 1, 4).withColumn("run_key", N.F.lit("r")), Echo())

    @dataclass
    class Second:
        def __call__(self, system, prompt, max_tokens):
            return "TITLE: T\nSibling seen here." if "An earlier part on similar code, T, says" in prompt else "TITLE: T\nNo sibling."

    flags = results.select("run_key", "section_id", N.F.lit("f").alias("flag"))
    got = {r["section_id"]: r["body"] for r in N.revise(results, flags, Second(), siblings=pairs).collect()}
    assert got == {"s0": "No sibling.", "s1": "Sibling seen here.", "s2": "Sibling seen here.", "s3": "No sibling."}
