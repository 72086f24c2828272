"""Small scratch tables have few files, however many partitions a shuffle has."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from corpusloom.llm.common import Scratch
from corpusloom.llm.components import components
from corpusloom.llm.jaccard_join import near_duplicate_groups

PARTITIONS = 48


@pytest.fixture
def many_partitions(spark):
    """Sessions that do not merge small partitions."""
    wanted = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """The number of files of each scratch table."""
    out, put = [], Scratch.put

    def counted(self, *args, **named):
        table = put(self, *args, **named)
        out.append(len(list(Path(self.paths[id(table)].removeprefix("file:")).glob("part-*"))))
        return table

    monkeypatch.setattr(Scratch, "put", counted)
    return out


def test_tables_of_the_join_have_few_files(many_partitions, files):
    rng = random.Random(5)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(90)]
        texts += [" ".join([*words, f"end{k}"]) for k in range(6)]
    got = near_duplicate_groups(many_partitions.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 6 for i in range(len(texts))}
    many = [n for n in files if n > PARTITIONS // 2]
    assert len(files) > 15 and len(many) <= 5


def test_bounds_hold_in_rounds(many_partitions, files):
    edges = many_partitions.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    got = components(edges, most=400).collect()
    assert {(r["node"], r["component"]) for r in got} == {(i, 0) for i in range(401)} and len(got) == 401
    assert max(files) <= many_partitions.sparkContext.defaultParallelism
