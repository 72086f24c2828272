"""Declared entries: the first candidate that exists, found without a row for each candidate."""

from __future__ import annotations

from itertools import product

from corpusloom.operators import graph as G
from corpusloom.queries import QUERIES
from pyspark.sql import functions as F

BASES = ["a", "lib/a", "a.js", "a.mjs", "a.jsx", "a.ts", "a.d.ts", "a.css", "a/index", "a/index.js", "a/index/index", "index", "index.ts", "x.json", "xindex", "a.js\n", "a.js.ts", ".ts", "/index", "", "é/ü.cjs"]


def candidates(base):
    stem = next((base.rstrip("\n")[: -len(e)] for e in (".mjsx", ".cjsx", ".jsx", ".mjs", ".cjs", ".js") if base.removesuffix("\n").endswith(e)), None)
    return [base + e for e in G.JS_RESOLVE] + [f"{base}/index{e}" for e in G.JS_RESOLVE[1:]] + ([] if stem is None else [stem + e for e in G.JS_SWAPS])


def nodes(plan):
    """All nodes of a plan that has run, those within stages too."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return nodes(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *(x for p in below for x in nodes(p))]


def test_stems_of_all_candidates(spark):
    b = F.col("b")
    rows = spark.createDataFrame([(x,) for x in BASES], "b string").select("b", F.array_compact(G.js_candidates(b)).alias("c"), F.transform(F.array_compact(G.js_candidates(b)), G.js_stem).alias("s"), G.candidate_stems(b).alias("k")).collect()
    for r in rows:
        assert r["c"] == candidates(r["b"])
        assert set(r["s"]) <= set(r["k"]) and len(r["k"]) == len(set(r["k"])) <= 4
    others = sorted({c for b in BASES for c in candidates(b)})
    pairs = spark.createDataFrame([(b, c) for b in BASES for c in others], "b string, c string")
    for r in pairs.select("b", "c", G.candidate_place(b, F.col("c")).alias("p")).collect():
        assert r["p"] == (candidates(r["b"]).index(r["c"]) + 1 if r["c"] in candidates(r["b"]) else 0)


def test_first_candidate_that_exists(spark):
    """For each base a repository with all its candidates from the n-th on, and the candidates of another base."""
    files, want = [], set()
    for b, n, other in product([x for x in BASES if x and not x.startswith("/") and "\n" not in x], (0, 1, 2, 14, 15, 16, 28, 29, 32), ("a", "index.mjs")):
        repo, listed = f"{b}|{n}|{other}", candidates(b)
        have = set(listed[n:]) | {c for c in candidates(other) if c not in listed}
        files += [(repo, "package.json", f'{{"main": "./{b}"}}')] + [(repo, p, "") for p in have]
        want |= {(repo, c) for c in listed[n : n + 1]}
    got = G.declared_entries(spark.createDataFrame(files, "repo_id string, path string, content string")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_rows_in_proportion_to_specifiers(spark, tmp_path):
    """33 rows for each specifier, from a stage that looks small, were broadcast: more than the driver holds."""
    n = 500
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["g14_declared_entries"](spark, str(tmp_path))
    assert len(df.collect()) == 3 * n
    made = [x.metrics().apply("numOutputRows").value() for x in nodes(df._jdf.queryExecution().executedPlan()) if x.metrics().contains("numOutputRows")]
    assert max(made) <= 10 * n
