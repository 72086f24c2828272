"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of one label are one class first, so a group of copies of any size is one row with a weight. Each class
gets one bucket per table from the signs of its projections on random hyperplanes. The number of bits follows the
largest label, so a bucket of unrelated vectors keeps about one row at any size; the number of tables then follows from
the recall wanted at the threshold. Buckets of one class go before any vector is moved. Buckets over BLOCK rows are cut
into blocks and each pair of blocks is a group of its own, so no task holds more than two blocks. In a group, cosines are
computed in double precision and each pair counts only in the first table that puts it together, which makes every link
count once without a shuffle of pairs. A group returns sums of links and the edges of its own components, never its
pairs.

Defined results: vectors that are null, empty or zero, hold null or non-finite components, or have a null label link
with nothing and are components of their own; vectors of different lengths do not link; usable rows with equal ids count
as vectors of their own, link by their own vectors and share a component; very large and very small components are
scaled by a power of two first; an empty table gives an empty table.

A bucket of n near copies costs what its links cost: every vector meets n / BLOCK blocks in each table that holds it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.components import components

BLOCK = 512
MISS = 1e-6
SEED = 97


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """Bits and tables: about one unrelated row in eight buckets, so that few vectors move, and a miss of a pair at the
    threshold below MISS."""
    bits = min(60, max(4, math.ceil(math.log2(max(2, largest))) + 3))
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log1p(-together)))


def buckets(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """rows x tables bucket numbers."""
    planes = np.random.default_rng(SEED + vectors.shape[1]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs.astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near one, so that squares neither overflow nor vanish."""
    _, power = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -power[:, None])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _sign(bits: int, tables: int):
    kind = pa.int32() if bits < 32 else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, vectors = batch.column(0), batch.column(2)
            sizes = np.diff(np.asarray(vectors.offsets))
            out = np.empty((len(cid), tables), np.int64)
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(vectors.offsets)
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                out[rows] = buckets(scaled(np.stack([flat[offsets[i] : offsets[i] + n] for i in rows])), bits, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cid) * tables + 1, tables), pa.int32()), pa.array(out.ravel()).cast(kind))
            yield pa.RecordBatch.from_arrays([cid, batch.column(1), lists], names=["cid", "label", "sig"])

    return run


def _local_roots(links: np.ndarray) -> np.ndarray:
    """The least row of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        low = np.where(links, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    """Sorted groups in; (a, links, null) and (a, null, b) out."""

    def group(cid, weight, t, side, vec, sig, out):
        n = len(cid)
        if n < 2:
            return
        links = vec @ vec.T >= threshold
        np.fill_diagonal(links, False)
        first = np.ones((n, n), bool)
        for k in range(t):
            first &= sig[:, k][:, None] != sig[:, k][None, :]
        links &= first
        if side.any():  # two blocks: only pairs across
            links &= side[:, None] != side[None, :]
        if not links.any():
            return
        rows = np.flatnonzero(links.any(axis=1))
        sums = links @ weight
        root = _local_roots(links)
        out.append((cid[rows], sums[rows], cid[root[rows]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            ids = held.column("g").to_numpy()
            cut = int(np.flatnonzero(ids != ids[-1])[-1]) + 1 if len(ids) and (ids != ids[-1]).any() else 0
            if cut:
                yield from work(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from work(held)

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        col = lambda c: rows.column(c).to_numpy()
        g, cid, weight, t, side = col("g"), col("cid"), col("weight"), col("t"), col("side")
        vectors, sigs = rows.column("v").chunk(0), rows.column("sig").chunk(0)
        sizes, out = np.diff(np.asarray(vectors.offsets)), []
        flat, offsets = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(vectors.offsets)
        sig = _matrix(sigs)
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        for lo, hi in zip(starts, np.r_[starts[1:], len(g)], strict=True):
            if hi - lo < 2:
                continue
            for n in np.unique(sizes[lo:hi]):
                at = lo + np.flatnonzero(sizes[lo:hi] == n)
                vec = scaled(np.stack([flat[offsets[i] : offsets[i] + n] for i in at]))
                vec /= np.sqrt((vec * vec).sum(axis=1))[:, None]
                group(cid[at], weight[at], int(t[lo]), side[at], vec, sig[at], out)
        if out:
            a, links, b = (np.concatenate([o[k] for o in out]) for k in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(links, pa.int64()), pa.array(b, pa.int64())], names=["a", "links", "b"])

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    spark = df.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    kind = "array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).cast(kind).alias("v"))
    usable = F.coalesce(
        F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    key = F.when(usable, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.transform("v", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))), 256))
    rows = scratch.put(rows.select("id", "label", "v", key.alias("class")))
    # a class has a number of its own, as ids may repeat with other vectors; the written table fixes the numbers
    classes = rows.filter("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = scratch.put(classes.withColumn("cid", F.monotonically_increasing_id()))
    of_label = classes.groupBy("label").count().agg(F.max("count").alias("n")).first()
    bits, tables = plan_tables(of_label["n"] or 1, threshold)
    kind = "int" if bits < 32 else "long"
    label_type = classes.schema["label"].dataType.simpleString()
    signed = scratch.put(classes.select("cid", "label", "v").mapInArrow(_sign(bits, tables), f"cid long, label {label_type}, sig array<{kind}>"))
    placed = signed.select("cid", "label", F.posexplode("sig").alias("t", "bucket"))
    sizes = placed.groupBy("label", "t", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = placed.join(sizes, ["label", "t", "bucket"])
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    shared = shared.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    spread = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spread = spread.select("cid", "t", F.xxhash64("label", "t", "bucket", low, high).alias("g"), F.when(low != high, (F.col("own") == high).cast("int") + 1).otherwise(0).alias("side"))
    full = spread.join(classes.select("cid", "weight", "v").join(signed.select("cid", "sig"), "cid"), "cid")
    dealt = full.select("g", "t", "side", "cid", "weight", "v", "sig").repartition("g").sortWithinPartitions("g")
    found = scratch.put(dealt.mapInArrow(_compare(threshold), "a long, links long, b long"))
    links = found.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("class_links"))
    numbered = scratch.put(rows.join(classes.select("class", "cid"), "class", "left").select("id", "cid"))
    # classes that share an id are one component
    shared_ids = numbered.filter("cid IS NOT NULL").groupBy("id").agg(F.min("cid").alias("b"), F.max("cid").alias("high")).filter("b < high").select("id", "b")
    same = numbered.join(shared_ids, "id").filter("cid <> b").select(F.col("cid").alias("a"), "b")
    joined = components(found.filter("a <> b").select("a", "b").union(same), scratch=scratch).select(F.col("node").alias("cid"), F.col("component").alias("root"))
    of_class = classes.select("cid", "rep", "weight").join(joined, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = of_class.join(least, "root").join(links, "cid", "left")
    out = numbered.join(of_class, "cid", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_col),
        (F.coalesce("class_links", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings; links of cosine 0.98 or more within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP3_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT p.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, p.component_id, p.vec_id = p.component_id AS kept
FROM parts p LEFT JOIN counts c ON p.vec_id = c.vec_id
"""
