"""Queries over the import graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import graph as G
from corpusloom.queries.fixture import FILES_SQL, MODULES_SQL, files, modules
from corpusloom.session import read_table


def _edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = modules(spark, sf_dir)
    scopes = m.select("repo_id").distinct().select("repo_id", F.lit("").alias("scope"), F.lit("@/").alias("prefix"), F.array(F.lit("src")).alias("targets"))
    return m, G.import_edges(m, G.candidate_paths(m, scopes))


def g1_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)[1].select("repo_id", "src", "dst")


def j6_imported_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.imported_by(_edges(spark, sf_dir)[1]).select("repo_id", "path", F.array_join("importers", " ").alias("importers"))


def j2_edge_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _edges(spark, sf_dir)
    return G.kept_edges(e, m.filter("seq % 3 <> 0")).select("repo_id", "src", "dst")


def j12_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir)[1].select("repo_id", "src", "dst")
    far = e.join(e.select("repo_id", F.col("src").alias("dst"), F.col("dst").alias("far")), ["repo_id", "dst"])
    return far.filter("src <> far").groupBy("repo_id", "src", "far").agg(F.count(F.lit(1)).alias("n_ways"))


def lfix_script_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _edges(spark, sf_dir)
    kinds = m.select("repo_id", "path", F.when(F.col("seq") % 40 == 0, "route").otherwise(P.category(F.col("path"))).alias("category"))
    kinds = kinds.withColumn("category", F.when(F.col("path").rlike("^(tools|lib)/"), "script").otherwise(F.col("category")))
    return G.promote_scripts(kinds, e.select("repo_id", "src", "dst"))


def l4_dfs_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _edges(spark, sf_dir)
    f = m.select("repo_id", "path", (F.col("seq") < 20).alias("is_entry"), F.lit("core").alias("category"))
    return G.reach_order(G.degrees(f, e), e)


def p8_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, e = _edges(spark, sf_dir)
    return G.degrees(m.select("repo_id", "path"), e)


def g16_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def g15_jsonc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.concat(F.lit('{ // note, one\n "a": "x//y,}", /* two */ "n": '), F.col("doc_id").cast("string"), F.lit(', "list": [1, 2,],\n}'))
    j = G.clean_json(text)
    return docs.select("doc_id", F.get_json_object(j, "$.a").alias("a"), F.get_json_object(j, "$.n").cast("long").alias("n"), F.get_json_object(j, "$.list").alias("list"))


def g16_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit('{"dependencies": {"dep'), (F.col("doc_id") % 13).cast("string"), F.lit('": "1"}, "devDependencies": {"dev'), k, F.lit('": "2"}}'))
    f = docs.select(F.col("source").alias("repo_id"), F.concat(F.lit("p"), k, F.lit("/package.json")).alias("path"), text.alias("content"))
    return G.dependencies(f).groupBy("repo_id", "dep").agg(F.count(F.lit(1)).alias("n"))


def j5_nearest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("repo_id", "path").distinct()
    scopes = f.select("repo_id").distinct().select("repo_id", F.explode(F.array(F.lit(""), F.lit("src"), F.lit("src/components"), F.lit("server"))).alias("scope"))
    return G.nearest_config(f, scopes)


_CATS = """kinds AS (SELECT repo_id, path, CASE WHEN seq % 40 = 0 AND NOT regexp_matches(path, '^(tools|lib)/') THEN 'route' WHEN regexp_matches(path, '^(tools|lib)/') THEN 'script'
  WHEN starts_with(path, 'src/core') THEN 'core' WHEN starts_with(path, 'src/ui') THEN CASE WHEN true THEN 'component' END ELSE 'route' END AS category FROM modules)"""
G1_SQL = f"WITH {MODULES_SQL} SELECT * FROM edges"
ORACLES = {
    "g1_import_edges": G1_SQL,
    "j6_imported_by": f"WITH {MODULES_SQL} SELECT repo_id, dst AS path, string_agg(src, ' ' ORDER BY src) AS importers FROM edges GROUP BY ALL",
    "j2_edge_semi": f"WITH {MODULES_SQL}, k AS (SELECT repo_id, path FROM modules WHERE seq % 3 <> 0) SELECT * FROM edges WHERE (repo_id, src) IN (SELECT (repo_id, path) FROM k) AND (repo_id, dst) IN (SELECT (repo_id, path) FROM k)",
    "j12_two_hops": f"WITH {MODULES_SQL} SELECT a.repo_id, a.src, b.dst AS far, count(*) AS n_ways FROM edges a JOIN edges b ON a.repo_id = b.repo_id AND a.dst = b.src WHERE a.src <> b.dst GROUP BY ALL",
    "lfix_script_promotion": f"""WITH RECURSIVE {MODULES_SQL}, {_CATS},
core(repo_id, path) AS (
  SELECT e.repo_id, e.dst FROM edges e JOIN kinds s ON s.repo_id = e.repo_id AND s.path = e.dst AND s.category = 'script'
    JOIN kinds o ON o.repo_id = e.repo_id AND o.path = e.src AND o.category <> 'script'
  UNION
  SELECT e.repo_id, e.dst FROM core c JOIN edges e ON e.repo_id = c.repo_id AND e.src = c.path JOIN kinds s ON s.repo_id = e.repo_id AND s.path = e.dst AND s.category = 'script')
SELECT repo_id, path, CASE WHEN (repo_id, path) IN (SELECT (repo_id, path) FROM core) THEN 'core' ELSE category END AS category FROM kinds""",
    "p8_degrees": f"WITH {MODULES_SQL} SELECT repo_id, path, (SELECT count(*) FROM edges e WHERE e.repo_id = m.repo_id AND e.src = m.path)::INT AS n_imports, (SELECT count(*) FROM edges e WHERE e.repo_id = m.repo_id AND e.dst = m.path)::INT AS n_importers FROM modules m",
    "g16_json_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key",
    "g15_jsonc": "SELECT doc_id, 'x//y,}' AS a, doc_id AS n, '[1,2]' AS list FROM documents",
    "g16_dependencies": "SELECT repo_id, dep, count(*) AS n FROM (SELECT source AS repo_id, 'dep' || (doc_id % 13) AS dep FROM documents UNION ALL SELECT source, 'dev' || doc_id FROM documents) GROUP BY ALL",
    "j5_nearest_config": f"""WITH {FILES_SQL} SELECT DISTINCT repo_id, path, CASE WHEN starts_with(path, 'src/components/') THEN 'src/components' WHEN starts_with(path, 'src/') THEN 'src'
  WHEN starts_with(path, 'server/') THEN 'server' ELSE '' END AS scope FROM files""",
}
QUERIES = {
    "g1_import_edges": g1_import_edges, "j6_imported_by": j6_imported_by, "j2_edge_semi": j2_edge_semi, "j12_two_hops": j12_two_hops,
    "lfix_script_promotion": lfix_script_promotion, "l4_dfs_reach": l4_dfs_reach, "p8_degrees": p8_degrees, "g16_json_keys": g16_json_keys,
    "g15_jsonc": g15_jsonc, "g16_dependencies": g16_dependencies, "j5_nearest_config": j5_nearest_config,
}
