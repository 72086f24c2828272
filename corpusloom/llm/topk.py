"""Exact top-k search by inner product with MaxScore.

Vectors become integers; a dimension is a term and its value in a vector the posting's weight. A shard is a batch of
candidates with, for each dimension, the least and the largest value; from these follow bounds of what a query's term
can add. As weights may be negative, a term counts by its surplus over its least possible addition in the shard. Terms
are ordered by the span of their bounds. With the query's k-th best score so far as threshold, the non-essential terms
are the longest tail of that order whose spans add up to less than the threshold asks for: a candidate without surplus
in the essential terms cannot reach it. Essential postings are traversed for all candidates of the shard, the others are
probed term group by term group, only for candidates whose score so far plus the bounds of what is left can still
compete. The threshold rises from shard to shard, and the cut moves with it. Each task returns its k best per query and
a last step merges them.

Queries and candidates are both rows of one exchange: queries lie in blocks of about QUERY_BLOCK, candidates in parts of
up to PART, both by hash, and every pair of a block and a part is a group. A task holds one block of queries and one
shard of candidates at a time; the candidates of a part stream past, so parts may be large. A first pass compares each
query with one pilot shard of about PILOT candidates, chosen by hash; the k-th best score there is a threshold that the
true k-th best reaches, and every group starts with it. The plan does not depend on the number of queries, and nothing
but two counts comes to the driver. What is shuffled are the candidates once for each block of queries and the queries
once for each part.

Defined results: null vectors and those with null or non-finite components take part on neither side; a zero vector
scores 0; ties go to the smaller id; a query with fewer than k other vectors gets them all; a repeated id is a candidate
each time, and not for a query of the same id; of queries with equal ids the answers are merged into one; vectors of
other lengths than a query are not compared with it; a score beyond 64 bits counts as the nearest 64-bit number; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Scratch, table

QUERY_BLOCK, PART, SHARD, PILOT = 8192, 1 << 20, 4096, 4096
#: Candidates that make a part of their own where there are fewer groups than cores.
LEAST_PART = 8192
#: Integers below this keep every product and sum exact in double precision, which is what makes the products fast.
EXACT = 2.0**53
LARGEST = 2**63 - 1


def to_integers(values: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(values.astype(np.float64) * scale)


def read_vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rows that hold a usable vector, and their values as doubles."""
    rows, out = [], []
    offsets = np.asarray(column.offsets)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64) if len(values) else np.zeros(0)
    good = np.isfinite(flat)  # nulls became nan
    for i, valid in enumerate(column.is_valid().to_pylist()):
        lo, hi = offsets[i], offsets[i + 1]
        if valid and hi > lo and good[lo:hi].all():
            rows.append(i)
            out.append(flat[lo:hi])
    return np.array(rows, dtype=np.int64), out


class ShardSearch:
    """The best k per query over the shards given so far. floors: a score for each query that its k-th best reaches, or -inf;
    `products` counts the terms that were multiplied, of candidates of moderate size."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.products = ids, queries, k, 0
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            at = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[at], ids[at]
        pool = self.best[q] + [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)]
        self.best[q] = sorted(pool)[: self.k]

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates of a shard: those of moderate size by MaxScore, the others in whole numbers of any size."""
        limit = np.sqrt(EXACT / (4 * vectors.shape[1]))
        small = np.abs(vectors).max(axis=1) < limit
        plain = np.abs(self.queries).max(axis=1) < limit
        if small.any() and plain.any():
            self._add_bounded(np.flatnonzero(plain), ids[small], vectors[small])
        for some, queries in ((small, ~plain), (~small, np.ones(len(plain), bool))):
            if some.any() and queries.any():
                self._add_exactly(np.flatnonzero(queries), ids[some], vectors[some])

    def _add_bounded(self, chosen: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        dims = vectors.shape[1]
        for q in chosen:
            query = self.queries[q]
            a, b = query * low, query * high
            least, most = np.minimum(a, b), np.maximum(a, b)
            span = most - least
            own = np.argsort(-span, kind="stable")
            # what the terms from a place on can add at most, and the span of their bounds
            left = np.r_[np.cumsum(most[own][::-1])[::-1], 0.0]
            spans = np.r_[np.cumsum(span[own][::-1])[::-1], 0.0]
            floor = max(float(self.floors[q]), float(-self.best[q][-1][0]) if len(self.best[q]) == self.k else -np.inf)
            if left[0] < floor:
                continue
            # essential: up to the place from which the spans no longer add up to what the threshold asks for
            cut = dims if floor == -np.inf else max(1, int(np.searchsorted(-spans, -(floor - least.sum()), side="right")))
            cut = min(cut, dims)
            alive = np.flatnonzero(ids != self.ids[q])
            part = (vectors[:, own[:cut]] @ query[own[:cut]])[alive]
            self.products += cut * len(alive)
            at = cut
            while len(alive):
                if floor > -np.inf:
                    keep = part + left[at] >= floor
                    alive, part = alive[keep], part[keep]
                if at >= dims or not len(alive):
                    break
                to = min(dims, at + max(4, dims // 8))
                part = part + vectors[np.ix_(alive, own[at:to])] @ query[own[at:to]]
                self.products += (to - at) * len(alive)
                at = to
            if len(alive):
                self._keep(q, part, ids[alive])

    def _add_exactly(self, chosen: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Values whose products may leave the exact doubles."""
        rows = [[int(x) for x in v] for v in vectors]
        for q in chosen:
            whole = [int(x) for x in self.queries[q]]
            scores = (max(-LARGEST - 1, min(LARGEST, sum(a * b for a, b in zip(whole, v, strict=True)))) for v in rows)
            pool = self.best[q] + [(-s, int(i)) for i, s in zip(ids, scores, strict=True) if i != self.ids[q]]
            self.best[q] = sorted(pool)[: self.k]


def maxscore_topk(candidates: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, id, score) for each query's k best candidates."""
    scratch = Scratch(candidates.sparkSession, "topk")
    kind = "array<float>" if {df.schema[vector].dataType.simpleString() for df in (candidates, queries)} == {"array<float>"} else "array<double>"
    rows = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(kind).alias("v")).filter("v IS NOT NULL AND id IS NOT NULL")
    asked, given = scratch.put(rows(queries)), rows(candidates)
    n_asked, n_given = asked.count(), given.count()
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    # as few parts as memory and the cores allow: each takes all queries
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-n_given // PART), min(-(-n_given // LEAST_PART), -(-2 * cores // blocks)))
    pilot = given.filter(F.pmod(F.xxhash64("id", F.lit("pilot")), F.lit(max(1, n_given // PILOT))) == 0)
    first = _met(asked.withColumn("floor", F.lit(None).cast("long")), pilot, blocks, 1, k, scale)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    floors = first.withColumn("rank", rank).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    found = _met(scratch.put(asked.join(floors, "id", "left")), given, blocks, parts, k, scale)
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _met(asked: DataFrame, given: DataFrame, blocks: int, parts: int, k: int, scale: int) -> DataFrame:
    """(query_id, id, score): the k best of each query (id, v, floor) in each part of the candidates (id, v)."""
    number = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = asked.select(number(blocks).alias("block"), every(parts).alias("part"), F.lit(True).alias("is_query"), "id", "v", "floor").unionByName(
        given.select(every(blocks).alias("block"), number(parts).alias("part"), F.lit(False).alias("is_query"), "id", "v", F.lit(None).cast("long").alias("floor"))
    )
    dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", F.desc("is_query"), "id")
    return dealt.mapInArrow(_searcher(k, scale), "query_id long, id long, score long")


def _searcher(k: int, scale: int):
    """Groups of a block's queries and a part's candidates, queries first, in; the best k of each query out."""

    class Group:
        def __init__(self) -> None:
            self.asked: dict[int, dict[tuple[int, bytes], tuple[np.ndarray, float]]] = {}
            self.searches: dict[int, ShardSearch] | None = None

        def ask(self, ids: np.ndarray, vectors: list[np.ndarray], floors: np.ndarray) -> None:
            for i, v, floor in zip(ids, vectors, floors, strict=True):
                self.asked.setdefault(len(v), {}).setdefault((int(i), v.tobytes()), (v, floor))

        def give(self, ids: np.ndarray, vectors: list[np.ndarray]) -> None:
            if self.searches is None:
                known = {n: (np.array([key[0] for key in own]), to_integers(np.stack([v for v, _ in own.values()]), scale), np.array([f for _, f in own.values()])) for n, own in self.asked.items()}
                self.searches = {n: ShardSearch(of, queries, k, floors) for n, (of, queries, floors) in known.items()}
            sizes = np.array([len(v) for v in vectors])
            for n, search in self.searches.items():
                own = np.flatnonzero(sizes == n)
                for at in range(0, len(own), SHARD):
                    some = own[at : at + SHARD]
                    search.add(ids[some], to_integers(np.stack([vectors[j] for j in some]), scale))

        def best(self) -> Iterator[pa.RecordBatch]:
            for search in (self.searches or {}).values():
                of_id: dict[int, list[tuple[int, int]]] = {}
                for q, best in zip(search.ids, search.best, strict=True):
                    of_id.setdefault(int(q), []).extend(best)
                rows = [(q, i, -s) for q, best in of_id.items() for s, i in best]
                cols = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, Group()
        for batch in batches:
            if not batch.num_rows:
                continue
            block, part = (batch.column(c).to_numpy() for c in (0, 1))
            is_query = batch.column(2).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]) | (is_query[1:] != is_query[:-1]), True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if key != (block[lo], part[lo]):
                    yield from group.best()
                    key, group = (block[lo], part[lo]), Group()
                own = batch.slice(lo, hi - lo)
                at, vectors = read_vectors(own.column(4))
                ids = own.column(3).to_numpy()[at]
                if is_query[lo]:
                    floors = own.column(5).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)[at]
                    group.ask(ids, vectors, floors)
                else:
                    group.give(ids, vectors)
        yield from group.best()

    return run


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = maxscore_topk(vectors, vectors.filter(F.col("vec_id") % 100 == 0))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP6_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
