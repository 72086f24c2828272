"""The driver's documents seen as repositories of files: paths, sizes and injected code that follow from doc_id.

The same rows are spelled twice, as a DataFrame and as DuckDB SQL, so that queries and oracles share nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import read_table

PATHS = [
    "src/app/page{k}.tsx", "src/lib/store{k}.ts", "src/components/ui/button{k}.tsx", "node_modules/pkg{k}/index.js", "dist/bundle{k}.js",
    "docs/guide{k}.md", "package-lock.json", "tests/unit/test_{k}.py", "server/api/users{k}.py", "scripts/build{k}.sh", "assets/logo{k}.png",
    "src/generated/model{k}.pb.go", "public/app{k}.min.js", ".env.production", ".env.example", "config/settings{k}.yaml", "infra/main{k}.tf",
    "src/components/Card{k}.vue", "src/hooks/useThing{k}.ts", "src/styles/theme{k}.scss", "data/rows{k}.csv", "db/migrations/{k}_init.sql",
    "README.md", "src/utils/format{k}.ts", "main.go", "src/main.rs", "cmd/tool{k}/main.go", "lib/index.ts", "tools/gen{k}.py", "LICENSE",
    "src/views/Home{k}.jsx", "src/core/engine{k}.rs", "notes/readme.txt", "vendor/lib{k}.php", "App.xcodeproj/project{k}.pbxproj", "Makefile",
    "src/types/index{k}.d.ts", "static/js/widget{k}.js", "templates/mail{k}.html", "src/deep/a/b/c/module{k}.java", "keys/id_rsa", "big/archive{k}.json",
]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, seq, path, size, content."""
    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id").cast("string")
    path = F.replace(F.element_at(F.lit(PATHS), (F.col("doc_id") % len(PATHS) + 1).cast("int")), F.lit("{k}"), k)
    size = F.when(F.col("doc_id") % 37 == 5, 200_000).when(F.col("doc_id") % 41 == 7, 0).when(F.col("doc_id") % 29 == 3, 70_000).otherwise(F.octet_length("text"))
    return docs.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("seq"), path.alias("path"), size.cast("long").alias("size"), F.col("text").alias("content"))


_LIST = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
FILES_SQL = f"""files AS (
  SELECT source AS repo_id, doc_id AS seq, replace({_LIST}[(doc_id % {len(PATHS)} + 1)::INT], '{{k}}', doc_id::VARCHAR) AS path,
         (CASE WHEN doc_id % 37 = 5 THEN 200000 WHEN doc_id % 41 = 7 THEN 0 WHEN doc_id % 29 = 3 THEN 70000 ELSE strlen(text) END)::BIGINT AS size,
         text AS content
  FROM documents)"""

FOLDERS = ["src/core", "src/ui", "lib/util", "tools/run", "app/api"]
ENDINGS = [".ts", ".tsx", "/index.ts", ".js"]


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo_id, seq, path, content: files that import the tenth and the thirtieth file after them."""
    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    at = lambda x: F.element_at(F.lit(FOLDERS), (x % 5 + 1).cast("int"))
    path = lambda x: F.concat(at(x), F.lit("/m"), x.cast("string"), F.element_at(F.lit(ENDINGS), (F.floor(x / 5) % 4 + 1).cast("int")))
    up = F.when(F.floor(k / 5) % 4 == 2, F.lit("../../../")).otherwise(F.lit("../../"))
    one = F.concat(F.lit("import { a } from '"), up, at(k + 10), F.lit("/m"), (k + 10).cast("string"), F.lit("';\n"))
    two = F.concat(F.lit('const b = require("'), up, at(k + 30), F.lit("/m"), (k + 30).cast("string"), F.lit('");\n'))
    alias = F.concat(F.lit("import '@/core/m"), (k + 20 - k % 5).cast("string"), F.lit("?raw';\n"))
    return docs.select(F.concat(F.lit("r"), (k % 10).cast("string")).alias("repo_id"), k.alias("seq"), path(k).alias("path"), F.concat(one, two, F.when(k % 10 == 0, alias).otherwise(F.lit("")), F.lit("export const n = 1;\n")).alias("content"))


_F = "[" + ", ".join(f"'{x}'" for x in FOLDERS) + "]"
_E = "[" + ", ".join(f"'{x}'" for x in ENDINGS) + "]"
MODULES_SQL = f"""modules AS (
  SELECT 'r' || (doc_id % 10) AS repo_id, doc_id AS seq,
         {_F}[(doc_id % 5 + 1)::INT] || '/m' || doc_id || {_E}[((doc_id // 5) % 4 + 1)::INT] AS path
  FROM documents),
edges AS (
  SELECT DISTINCT a.repo_id, a.path AS src, b.path AS dst FROM modules a JOIN modules b
  ON b.seq IN (a.seq + 10, a.seq + 30) OR (a.seq % 10 = 0 AND b.seq = a.seq + 20)
  WHERE a.repo_id = b.repo_id)"""
