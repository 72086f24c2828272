"""Archives as a data source: entries as read, bounded memory, errors as rows."""

from __future__ import annotations

import gzip
import io
import json
import os
import random
import subprocess
import sys
import tarfile

import pytest
from corpusloom.sources import archive
from pyspark.sql import functions as F


def tarball(entries, mode="w:gz") -> bytes:
    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode=mode) as tar:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
            elif isinstance(data, str):
                info.type, info.linkname = tarfile.SYMTYPE, data
            info.size = len(data) if isinstance(data, bytes) else 0
            tar.addfile(info, io.BytesIO(data) if isinstance(data, bytes) else None)
    return raw.getvalue()


def rows_of(df):
    return {(r["repo_id"], r["seq"], r["path"], r["size"], bytes(r["bytes"]) if r["bytes"] is not None else None, r["error"]) for r in df.collect()}


def test_entries_and_errors(spark, tmp_path):
    good = [("x-1/", None), ("x-1/a/b.ts", b"x" * 10), ("x-1/link", "a/b.ts"), ("x-1/" + "deep/" * 60 + "long.ts", b"long"), ("top", b"no folder"), ("x-1/empty", b"")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "good.tar.gz").write_bytes(tarball(good))
    (tmp_path / "sub" / "plain.tar").write_bytes(tarball(good[:2], "w"))
    (tmp_path / "not.tgz").write_bytes(b"\x1f\x8bnothing")
    (tmp_path / "void.tar").write_bytes(b"")
    whole = tarball([("z-1/a", random.Random(1).randbytes(50_000)), ("z-1/b", random.Random(2).randbytes(900_000))])
    (tmp_path / "cut.tar.gz").write_bytes(whole[:300_000])
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = rows_of(archive.read_archives(spark, str(tmp_path), max_read=4))
    long = "deep/" * 60 + "long.ts"
    want = {("good", 0, "a/b.ts", 10, b"xxxx", None), ("good", 1, long, 4, b"long", None), ("good", 2, "empty", 0, b"", None), ("plain", 0, "a/b.ts", 10, b"xxxx", None)}
    want |= {(name, -1, None, None, None, "unreadable") for name in ("not", "cut", "void")}
    # the second file of the cut archive is met before its end is missed
    want |= {("cut", 0, "a", 50_000, random.Random(1).randbytes(50_000)[:4], None), ("cut", 1, "b", 900_000, random.Random(2).randbytes(900_000)[:4], None)}
    assert got == want
    errors = archive.archive_errors(archive.read_archives(spark, str(tmp_path)))
    assert {tuple(r) for r in errors.collect()} == {("not", "archive", "unreadable"), ("cut", "archive", "unreadable"), ("void", "archive", "unreadable")}


def test_limits(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.tar.gz").write_bytes(tarball([(f"{name}-1/{i}", bytes([i]) * 3000) for i in range(9)]))
    (tmp_path / "big.tar").write_bytes(tarball([("b-1/x", b"z" * 200_000)], "w"))
    read = lambda **k: archive.read_archives(spark, str(tmp_path), **k)
    assert {(r["repo_id"], r["error"]) for r in read(max_archive=100_000).filter("error IS NOT NULL").collect()} == {("big", "too_large")}
    few = read(max_entries=4)
    assert {r["repo_id"]: r["n"] for r in few.filter("error IS NULL").groupBy("repo_id").agg(F.count("*").alias("n")).collect()} == {"a": 4, "b": 4, "c": 4, "big": 1}
    assert few.filter("error = 'too_large'").count() == 3
    small = read(max_inflated=12_000)  # read in blocks: what came before the bound stays
    assert {r["repo_id"] for r in small.filter("error = 'too_large'").collect()} == {"a", "b", "c", "big"}
    assert read(partition_bytes=0).rdd.getNumPartitions() == 4
    assert read().rdd.getNumPartitions() == 1
    assert rows_of(read(partition_bytes=0)) == rows_of(read()) == rows_of(archive.read_archives(spark, f"file://{tmp_path}"))
    cells = spark.read.format("binaryFile").load(str(tmp_path)).select(F.regexp_extract("path", r"(\w+)\.tar", 1).alias("repo_id"), "content")
    assert rows_of(archive.read_entries(cells)) == rows_of(read())
    assert rows_of(archive.read_entries(spark.createDataFrame([("n", None)], "repo_id string, content binary"))) == {("n", -1, None, None, None, "unreadable")}
    with pytest.raises(Exception, match="nowhere"):
        archive.read_archives(spark, str(tmp_path / "nowhere")).collect()


def test_rule_files_are_read_beyond_the_bound_of_others(spark, tmp_path):
    rules = b"a.tmp\n" * 30_000
    (tmp_path / "r.tar.gz").write_bytes(tarball([("r-1/.gitignore", rules), ("r-1/a.ts", rules)]))
    got = {r["path"]: len(r["bytes"]) for r in archive.read_archives(spark, str(tmp_path)).collect()}
    assert got == {".gitignore": 180_000, "a.ts": archive.MAX_READ}


WORKER = """
import json, resource, sys
import pyarrow  # before the bound: libraries are mapped
from corpusloom.sources import archive
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
reader = archive.ArchiveReader({"path": sys.argv[1], "max_archive": 4 << 30, "max_inflated": 4 << 30})
rows = [(r["path"], r["size"], len(r["bytes"]) if r["bytes"] is not None else None, r["error"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
print(json.dumps([rows, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - base]))
"""


@pytest.mark.parametrize("packed", [False, True])
def test_memory_does_not_follow_the_archive(tmp_path, packed):
    """Two gigabytes and more in one archive; the reader's memory grows by less than 64 MB."""
    info = tarfile.TarInfo("big-1/video.bin")
    info.size = 2_200_000_000 if not packed else 600_000_000
    tail = tarball([("big-1/after.ts", b"still read")], "w")
    path = tmp_path / ("big.tar.gz" if packed else "big.tar")
    if packed:
        with gzip.open(path, "wb", compresslevel=1) as out:
            out.write(info.tobuf())
            for _ in range(600):
                out.write(bytes(1_000_000))
            out.write(bytes(-info.size % 512) + tail)
    else:  # a hole in the file takes no room on the disk
        with open(path, "wb") as out:
            out.write(info.tobuf())
            out.seek(info.size + -info.size % 512, 1)
            out.write(tail)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", WORKER, str(path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300, check=True)
    rows, grown = json.loads(said.stdout)
    assert rows == [["video.bin", info.size, archive.MAX_READ, None], ["after.ts", 10, 10, None]]
    assert grown < 64 * 1024


def test_fetch_errors(spark):
    cases = [
        (None, None, None, None, False, "unreachable"), (200, None, None, None, False, None), (200, None, None, 1 << 30, True, "too_large"), (404, "0", None, None, False, "not_found"),
        (401, None, None, None, True, "misconfigured"), (401, None, None, None, False, "not_found"), (403, "0", None, None, False, "rate_limited"), (403, "7", None, None, True, "not_found"),
        (403, None, "30", None, False, "rate_limited"), (429, None, None, None, True, "rate_limited"), (500, None, None, None, False, "unreachable"), (302, None, None, None, False, "unreachable"),
    ]
    df = spark.createDataFrame(cases, "status int, remaining string, retry string, declared long, token boolean, want string")
    got = df.withColumn("got", archive.fetch_error(F.col("status"), F.col("remaining"), F.col("retry"), F.col("declared"), F.col("token")))
    assert [r for r in got.collect() if r["got"] != r["want"]] == []
