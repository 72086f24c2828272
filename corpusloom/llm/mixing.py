"""Mixing sources to target weights by hash-seeded Poisson replication.

Each source gets a mean repetition rate: rate = total * weight / (sum of weights * its documents). A document's number
of copies is a Poisson variate of that mean, found by inverting the distribution at a uniform value that is the hash of
seed and id; so a lost task makes the same copies again. Large means are split into equal parts whose variates add up,
each with its own hash, so that no distribution table grows or underflows. Copies are then dealt out by a hash of
seed, id and copy number and sorted by it: a global shuffle that no source can skew.

Only the count per source is gathered from the corpus. The table of rates is written to the shared folder, so the
planner knows its size and broadcasts it while small; a larger one is joined by sort-merge with AQE's skew splitting.

Defined results: a null source is a source of its own; a row without id draws by a hash of its content (columns that hold
maps left out); repeated ids get equal numbers of copies, and so do equal rows without id; an empty table gives an empty
table; a source without weight, or with a weight of zero or less, gets no copies; columns named like the added ones are
replaced. Copies are dealt by key and content, so rows of one id meet in a task only where they are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, table, without

#: Means above this are split into equal parts of at most this size.
PART = 16.0
#: Entries of a part's distribution: beyond, the tail is below the resolution of the uniform values.
STEPS = 96
SEED = 20240229


def _hash(*parts) -> F.Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def uniform(*parts) -> F.Column:
    """52 bits of md5 as a double in [0, 1)."""
    return F.conv(F.substring(_hash(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()


def rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, alpha: float, source: str) -> DataFrame:
    """Per source: documents, rate, parts, and the cumulative distribution of a part."""
    spark = docs.sparkSession
    counts = Scratch(spark, "mix").put(docs.groupBy(F.col(source).alias("mix_source")).agg(F.count(F.lit(1)).alias("mix_n")))
    if weights is None:
        weighted = counts.withColumn("mix_w", F.pow(F.col("mix_n").cast("double"), F.lit(float(alpha))))
    else:
        rows = [(None if k is None else str(k), float(v)) for k, v in weights.items()]
        given = spark.createDataFrame(rows, T.StructType([T.StructField("mix_key", T.StringType()), T.StructField("mix_w", T.DoubleType())]))
        weighted = counts.join(given, F.col("mix_source").cast("string").eqNullSafe(F.col("mix_key")), "left").drop("mix_key")
        weighted = weighted.withColumn("mix_w", F.greatest(F.coalesce("mix_w", F.lit(0.0)), F.lit(0.0)))
    sums = weighted.agg(F.sum("mix_n").alias("n"), F.sum("mix_w").alias("w")).first()
    n, w = float(sums["n"] or 0), float(sums["w"] or 0)
    want = n if total is None else float(total)
    rate = F.lit(0.0) if w <= 0 else F.lit(want) * F.col("mix_w") / (F.lit(w) * F.col("mix_n"))
    out = weighted.withColumn("mix_rate", rate).withColumn("mix_parts", F.greatest(F.ceil(F.col("mix_rate") / F.lit(PART)), F.lit(1)).cast("int"))
    out = out.withColumn("mix_mean", F.col("mix_rate") / F.col("mix_parts"))
    cdf = F.expr(
        f"aggregate(sequence(1, {STEPS}), named_struct('p', exp(-mix_mean), 'c', array(exp(-mix_mean))),"
        " (a, k) -> named_struct('p', a.p * mix_mean / k, 'c', array_append(a.c, element_at(a.c, -1) + a.p * mix_mean / k)), a -> a.c)"
    )
    return out.select("mix_source", "mix_rate", "mix_parts", cdf.alias("mix_cdf"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    alpha: float = 0.5,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """Replicates and shuffles docs; adds rate (double), copy (int, from 1), n_copies (int) and shuffle_key (string).

    weights: target weight of each source; None: documents to the power alpha. total: expected rows out; None: as many as come in."""
    docs = without(docs, "rate", "copy", "n_copies", "shuffle_key", "mix_source", "mix_rate", "mix_parts", "mix_cdf", "mix_row")
    per_source = Scratch(docs.sparkSession, "mix-rates").put(rates(docs, weights, total, alpha, source_col))
    hashable = [f"`{f.name}`" for f in docs.schema.fields if not _holds_map(f.dataType)]
    marked = docs.withColumn("mix_row", F.xxhash64(*hashable)) if hashable else docs.withColumn("mix_row", F.lit(0))
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("row "), F.col("mix_row").cast("string")))
    joined = marked.join(per_source, marked[source_col].eqNullSafe(per_source["mix_source"]))
    # one uniform value for each part, drawn once and held as an array element while the distribution is walked
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda part: uniform(F.lit(seed), ident, part))
    drawn = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    counted = joined.withColumn("n_copies", drawn).filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    keyed = copies.withColumn("shuffle_key", _hash(F.lit(seed), F.lit("order"), ident, F.col("copy"))).withColumnRenamed("mix_rate", "rate")
    # rows of one id that differ go their own ways
    dealt = keyed.drop("mix_source", "mix_parts", "mix_cdf").repartition("shuffle_key", "mix_row")
    return dealt.sortWithinPartitions("shuffle_key", id_col, "copy").drop("mix_row")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated towards weights that grow with the square root of a source's size, then shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mix_sources(docs)
    return out.select("doc_id", "source", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key", "text")


OP9_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, sqrt(n::DOUBLE) AS w FROM counts),
sums AS (SELECT sum(n)::DOUBLE AS n, sum(w) AS w FROM weighted),
rated AS (SELECT a.source, s.n * a.w / (s.w * a.n) AS rate FROM weighted a, sums s),
parted AS (SELECT source, rate, greatest(ceil(rate / {PART}), 1)::INT AS parts FROM rated),
means AS (SELECT source, rate, parts, rate / parts AS mean FROM parted),
steps AS (
  SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS c, mean FROM means
  UNION ALL
  SELECT source, k + 1, p * mean / (k + 1), c + p * mean / (k + 1), mean FROM steps WHERE k < {STEPS}
),
draws AS (
  SELECT d.doc_id, d.source, d.text, m.rate, j.part,
         ('0x' || substr(md5('{SEED}:' || d.doc_id || ':' || j.part), 1, 13))::BIGINT::DOUBLE / {2**52} AS u
  FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, LATERAL (SELECT unnest(range(1, m.parts + 1)) AS part) j
),
counted AS (
  SELECT w.doc_id, w.source, w.rate, w.part, count(s.k) AS n
  FROM draws w LEFT JOIN steps s ON w.source IS NOT DISTINCT FROM s.source AND s.c <= w.u
  GROUP BY w.doc_id, w.source, w.rate, w.part
),
copied AS (SELECT doc_id, source, rate, sum(n)::INT AS n_copies FROM counted GROUP BY doc_id, source, rate HAVING sum(n) > 0)
SELECT c.doc_id, c.source, round(c.rate, 9) AS rate, c.n_copies, t.copy::INT AS copy,
       md5('{SEED}:order:' || c.doc_id || ':' || t.copy) AS shuffle_key, d.text
FROM copied c JOIN documents d ON c.doc_id = d.doc_id, LATERAL (SELECT unnest(range(1, c.n_copies + 1)) AS copy) t
"""
