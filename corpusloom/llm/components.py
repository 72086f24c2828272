"""Connected components of a graph of links, by alternating large-star and small-star steps.

Each round is two shuffles of the links: large-star hangs every larger neighbour of a node on the node's least neighbour,
small-star hangs a node's smaller neighbours and itself on the least of them. The graph keeps its components and shrinks
to stars in about log^2 rounds at most. Rounds are written to the shared folder, so that lineage stays short and a lost
executor costs one round; nothing but a count and a checksum comes to the driver. Least neighbours are found by a
pre-aggregated min and joined back, so a node with a huge neighbourhood is a row of the aggregation and a skewed join
key, which AQE splits, never a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch

MAX_ROUNDS = 60


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v")


def _apart(least: DataFrame) -> DataFrame:
    """The least neighbours with a key that the planner does not know to be dealt already: they get an exchange of their own,
    and AQE splits only joins of two exchanges. They are a row for each node, the links of a hub are not."""
    return least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u"), "m")


def _large_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. Both directions; larger neighbours move to the least of the closed neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = both.join(_apart(least), "u").filter("v > u")
    return _distinct(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u > v. A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(_apart(least), "u")
    links = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return _distinct(links)


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, most: int | None = None) -> DataFrame:
    """(node, component): the least node reachable, for every node that has a link. Links may repeat, in either direction.
    most: a bound on their number, if known; the tables of rounds then have few parts where they are small."""
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    now = scratch.put(_distinct(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))), most)
    mark = None
    for _ in range(MAX_ROUNDS):
        # a round makes two links of one at most
        after = scratch.put(_small_star(_large_star(now)), None if most is None else 2 * most)
        scratch.drop(now)
        now = after
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        most = None if most is None else seen["n"]
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.groupBy(F.col("v").alias("node")).agg(F.lit(1).alias("one")).select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
