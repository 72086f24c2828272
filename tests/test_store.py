"""Results that survive a failed save, and one bad repository among good ones."""

from __future__ import annotations

import json

import pytest
from corpusloom.plans.ingest import ingest
from corpusloom.sources import archive
from corpusloom.sources.results import error_status, load_tours, save_tours
from corpusloom.sources.store import results_store
from pyspark.sql import functions as F

from tests.test_archives import tarball


def rows(spark, *values):
    return spark.createDataFrame(list(values), "run_key string, section_id string, status string")


def held(store, version=None):
    df = store.load(version)
    return None if df is None else {(r["run_key"], r["section_id"], r["status"]) for r in df.collect()}


def test_later_attempts_replace_parts(spark, tmp_path):
    store = results_store(spark, str(tmp_path / "s"))
    assert held(store) is None and store.version() == 0
    assert store.save(rows(spark, ("r", "a", "failed"), ("r", "b", "done"))) == 1
    assert store.save(rows(spark, ("r", "a", "done"), ("q", "a", "done"))) == 2
    assert held(store) == {("r", "a", "done"), ("r", "b", "done"), ("q", "a", "done")}
    assert held(store, 1) == {("r", "a", "failed"), ("r", "b", "done")}
    assert store.save(rows(spark, ("x", "y", "done")), replace=True) == 3 and held(store) == {("x", "y", "done")}
    assert store.vacuum() == 2 and held(store) == {("x", "y", "done")} and store.version() == 3
    assert store.save(rows(spark, ("x", "z", "done")).withColumn("more", F.lit(1))) == 4 and len(held(store)) == 2


def test_a_save_that_dies_leaves_what_was_there(spark, tmp_path):
    store = results_store(spark, str(tmp_path / "s"))
    store.save(rows(spark, ("r", "a", "done")))
    with pytest.raises(Exception, match="boom"):
        store.save(rows(spark, ("r", "a", "new")).withColumn("status", F.raise_error(F.lit("boom")).cast("string")))
    assert held(store) == {("r", "a", "done")}
    store.write(rows(spark, ("r", "a", "written, never committed")))
    assert held(store) == {("r", "a", "done")}
    # a save that died between its claim and its manifest
    (tmp_path / "s" / "manifests" / "2.claim").touch()
    assert held(store) == {("r", "a", "done")}
    assert store.save(rows(spark, ("r", "b", "done"))) == 3 and held(store) == {("r", "a", "done"), ("r", "b", "done")}
    assert json.loads((tmp_path / "s" / "manifests" / "3.json").read_text())["attempts"][1]["number"] == 2


def test_two_saves_from_one_version_both_count(spark, tmp_path):
    one, two = (results_store(spark, str(tmp_path / "s")) for _ in range(2))
    a, b = one.write(rows(spark, ("r", "a", "done"))), two.write(rows(spark, ("r", "b", "done")))
    taken = two._taken
    two._taken = lambda: (two.__dict__.pop("_taken"), taken())[1] if one.version() else (one.commit(a), [])[1]
    assert two.commit(b) == 2 and held(one) == {("r", "a", "done"), ("r", "b", "done")}


def test_tours_replace_each_other_by_key(spark, tmp_path):
    tour = lambda conv, overview: spark.sql(f"select '{conv}' conv, '{overview}' overview, '' closing, array('x') parts")
    save_tours(tour("a", "old"), str(tmp_path / "t"))
    save_tours(tour("b", "other"), str(tmp_path / "t"))
    save_tours(tour("a", "new"), str(tmp_path / "t"))
    assert {(r["conv"], r["overview"]) for r in load_tours(spark, str(tmp_path / "t")).collect()} == {("a", "new"), ("b", "other")}


def test_one_bad_repository_among_good_ones(spark, tmp_path):
    source = b"import { b } from './b';\nexport const a = b;\n" * 3
    (tmp_path / "good.tar.gz").write_bytes(tarball([("g-1/src/a.ts", source), ("g-1/src/b.ts", b"export const b = 1;\nexport const c = 2;\n"), ("g-1/README.md", b"# Good\n\nIt is.\n")]))
    (tmp_path / "broken.tgz").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "cut.tar.gz").write_bytes(tarball([("c-1/a.ts", source), ("c-1/b.bin", __import__("random").Random(1).randbytes(90_000))])[:40_000])
    (tmp_path / "empty.tar.gz").write_bytes(tarball([("e-1/logo.png", b"\x89PNG"), ("e-1/blank.ts", b"  \n"), ("e-1/node_modules/x/index.js", b"x")]))
    (tmp_path / "ignored.tar.gz").write_bytes(tarball([("i-1/.gitignore", b"*.ts\n"), ("i-1/a.ts", source)]))
    (tmp_path / "huge.tar").write_bytes(tarball([("h-1/a.ts", b"z" * 50_000)], "w"))
    got = ingest(archive.read_archives(spark, str(tmp_path), max_archive=45_000))
    assert {(r["repo_id"], r["path"]) for r in got.files.collect()} == {("good", "src/a.ts"), ("good", "src/b.ts"), ("good", "README.md")}
    assert {(r["src"], r["dst"]) for r in got.edges.collect()} == {("src/a.ts", "src/b.ts")}
    want = {("broken", "archive", "unreadable"), ("cut", "archive", "unreadable"), ("huge", "archive", "too_large"), ("empty", "filter", "empty"), ("ignored", "filter", "empty")}
    assert {tuple(r) for r in got.errors.collect()} == want
    assert {(r["repo_id"], r["reason"]) for r in got.skipped.collect() if r["repo_id"] == "ignored"} == {("ignored", "gitignored")}
    codes = spark.createDataFrame([(None,), ("empty",), ("too_large",), ("odd",)], "c string").select(error_status(F.col("c")).alias("s"))
    assert [r["s"] for r in codes.collect()] == [200, 422, 413, 500]
