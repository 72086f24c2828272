"""Imports of every language but JavaScript's own form: a document is a source file and the file that it imports, which holds
the document's text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import graph as G
from corpusloom.operators import lint as L
from corpusloom.operators import plan as PL
from corpusloom.plans.tour import open_folders
from corpusloom.queries.fixture import FILES_SQL, files
from corpusloom.queries.narration import PARTS_SQL, SENT_SQL, _parts
from corpusloom.session import read_table
from corpusloom.sources import archive
from corpusloom.sources.results import chosen_refs

#: (source, its import, target) of each kind; {k} is the document's id.
KINDS = (
    ("h{k}/index.html", '<script src="./app{k}.js"></script>', "h{k}/app{k}.js"),
    ("c{k}/a.scss", "@import 'part{k}';", "c{k}/_part{k}.scss"),
    ("py{k}/mod.py", "from . import util{k}", "py{k}/util{k}.py"),
    ("pk{k}/main.py", "import os, pk{k}.deep", "pk{k}/deep.py"),
    ("go{k}/main.go", 'import "m/core{k}"', "core{k}/a.go"),
    ("rb{k}/t.rb", "require_relative 'v{k}'", "rb{k}/v{k}.rb"),
    ("rs{k}/main.rs", "mod net{k};", "rs{k}/net{k}.rs"),
    ("cc{k}/x.c", '#include "x{k}.h"', "cc{k}/x{k}.h"),
    ("p{k}/a.php", "<?php require 'b{k}.php';", "p{k}/b{k}.php"),
    ("q{k}/a.php", "<?php\nuse App\\Model\\U{k};", "app/Model/U{k}.php"),
    ("j{k}/App.java", "import j{k}.util.Tool{k};", "j{k}/util/Tool{k}.java"),
    ("da{k}/a.dart", "import 'package:demo/z{k}.dart';", "lib/z{k}.dart"),
)


def g2_language_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2, G5 to G13 in one graph."""
    k = F.col("doc_id")
    at = lambda i: F.replace(F.element_at(F.lit([kind[i] for kind in KINDS]), (k % len(KINDS) + 1).cast("int")), F.lit("{k}"), k.cast("string"))
    docs = read_table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (k % 10).cast("string")).alias("repo_id"), at(0).alias("source"), at(1).alias("code"), at(2).alias("target"), "text")
    both = F.array(F.struct(F.col("source").alias("path"), F.col("code").alias("content")), F.struct(F.col("target").alias("path"), F.coalesce("text", F.lit("")).alias("content")))
    f = docs.select("repo_id", F.explode(both).alias("f")).select("repo_id", "f.*")
    roots, psr4 = F.array(F.lit(""), F.lit("src")), F.array(F.struct(F.lit("App\\").alias("prefix"), F.lit("app").alias("dir")))
    hints = docs.select("repo_id").distinct().select("repo_id", F.lit("m").alias("go_module"), roots.alias("py_roots"), psr4.alias("psr4"), F.lit("demo").alias("dart_package"))
    return G.import_edges(f, G.candidate_paths(f, None, hints), G.folder_imports(f, hints)).select("repo_id", "src", "dst")


def _kinds_sql(i: int) -> str:
    return "replace([" + ", ".join("'" + kind[i].replace("'", "''") + "'" for kind in KINDS) + f"][(doc_id % {len(KINDS)} + 1)::INT], '{{k}}', doc_id::VARCHAR)"


def w3_folder_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    opened = F.when(F.col("part") % 3 != 1, F.lit("The Store hooks, in the data layer folder keep it. ")).otherwise(F.lit(""))
    return L.folder_openings(p.select("conv", "part", F.concat(opened, "body").alias("body")))


W3_SQL = f"""WITH {PARTS_SQL}, o AS (SELECT conv, part, regexp_matches(trim(CASE WHEN part % 3 <> 1 THEN 'The Store hooks, in the data layer folder keep it. ' ELSE '' END || body), '^The [A-Z][\\w ]{{0,40}}?,? in the [\\w ]{{1,30}} folder\\b') AS f FROM parts),
e AS (SELECT *, coalesce(sum(f::INT) OVER (PARTITION BY conv ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier FROM o)
SELECT conv, part, earlier FROM e WHERE f AND earlier >= 2"""


def t9_folded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence as a flag by its first word and length, without repeats, the first twenty of a conversation's four parts."""
    from corpusloom.functions import text as X

    each = _parts(spark, sf_dir).select("conv", (F.col("part") % 4).alias("part"), F.posexplode(X.sentences(F.col("body"))).alias("pos", "s"))
    flags = each.select("conv", "part", F.col("pos").alias("ord"), F.concat_ws(" ", F.element_at(F.split("s", " "), 1), (F.length("s") % 7).cast("string")).alias("message"))
    return L.fold_flags(flags).select("conv", "part", "ord", "message")


T9_SQL = f"""WITH {SENT_SQL}, f AS (SELECT conv, part % 4 AS part, string_split(sentence, ' ')[1] || ' ' || (length(sentence) % 7) AS message, min(pos)::INT AS ord FROM sents GROUP BY ALL)
SELECT conv, part, ord, message FROM f QUALIFY row_number() OVER (PARTITION BY conv, part ORDER BY ord, message) <= 20"""


def s4_chosen_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two candidates for each page; which refs exist follows from the page."""
    k = F.col("page_id")
    pages = read_table(spark, sf_dir, "pages").select(k.cast("string").alias("repo_id"))
    pair = F.array(F.struct(F.lit("feature").alias("ref"), F.lit("x/src").alias("subpath")), F.struct(F.lit("feature/x").alias("ref"), F.lit("src").alias("subpath")))
    asked = pages.select("repo_id", F.posexplode(pair).alias("ord", "c")).select("repo_id", "ord", "c.*")
    there = F.array_compact(F.array(F.when(k % 4 != 3, F.lit("main")), F.when(k % 4 == 0, F.lit("feature/x")), F.when(k % 8 == 1, F.lit("feature"))))
    exist = read_table(spark, sf_dir, "pages").select(k.cast("string").alias("repo_id"), F.explode(there).alias("ref"))
    return chosen_refs(asked, exist)


S4_SQL = """SELECT page_id::VARCHAR AS repo_id, CASE WHEN page_id % 8 = 1 THEN 'feature' WHEN page_id % 4 = 0 THEN 'feature/x' END AS ref, CASE WHEN page_id % 8 = 1 THEN 'x/src' WHEN page_id % 4 = 0 THEN 'src' END AS subpath,
  CASE WHEN page_id % 8 = 1 OR page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 3 THEN 'not_found' ELSE 'bad_ref' END AS error FROM pages"""


def s3_fetch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of all shapes, one for each page."""
    k = F.col("page_id")
    status = F.element_at(F.lit([200, 204, 302, 401, 403, 404, 429, 500, 503]), (k % 9 + 1).cast("int"))
    declared = F.when(k % 4 == 0, F.octet_length("html").cast("long") * 100_000)
    code = archive.fetch_error(F.when(k % 10 != 9, status), F.when(k % 3 == 0, (k % 2).cast("string")), F.when(k % 5 == 0, F.lit("30")), declared, k % 7 == 0)
    return read_table(spark, sf_dir, "pages").select("page_id", code.alias("code"))


S3_SQL = """WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 10 <> 9 THEN [200, 204, 302, 401, 403, 404, 429, 500, 503][(page_id % 9 + 1)::INT] END AS s, page_id % 3 = 0 AND page_id % 2 = 0 AS spent, page_id % 5 = 0 AS later,
  page_id % 4 = 0 AND strlen(html) * 100000 > 157286400 AS large, page_id % 7 = 0 AS own FROM pages)
SELECT k AS page_id, CASE WHEN s IS NULL THEN 'unreachable' WHEN own AND s = 401 THEN 'misconfigured' WHEN s = 429 OR (s = 403 AND (spent OR later)) THEN 'rate_limited' WHEN s IN (401, 403, 404) THEN 'not_found'
  WHEN s NOT BETWEEN 200 AND 299 THEN 'unreachable' WHEN large THEN 'too_large' END AS code FROM p"""


def s5_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into gzipped tars of a hundred, read back: entries of at most 1000 bytes each, and a digest of what was read."""
    import io
    import tarfile

    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = io.BytesIO()
        with tarfile.open(fileobj=raw, mode="w:gz", compresslevel=1) as tar:
            for k, text in sorted(zip(pdf["doc_id"], pdf["text"], strict=True)):
                data = (text or "").encode()
                info = tarfile.TarInfo(f"top/docs/{k}.txt")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"repo_id": [str(pdf["doc_id"].iloc[0] // 100)], "content": [raw.getvalue()]})

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 100).alias("g"))
    tars = docs.groupBy("g").applyInPandas(pack, "repo_id string, content binary")
    return archive.read_entries(tars, max_read=1000).select("repo_id", "seq", "path", "size", F.sha2("bytes", 256).alias("sha"), "error")


S5_SQL = """SELECT (doc_id // 100)::VARCHAR AS repo_id, row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1 AS seq, 'docs/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size,
  sha256(encode(coalesce(text, ''))[1:1000]) AS sha, NULL AS error FROM documents"""


def t11_open_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_folders(files(spark, sf_dir).select("repo_id", "path"), small=40, large=120)


T11_SQL = f"""WITH {FILES_SQL}, s AS (SELECT repo_id, string_split(path, '/') AS p, count(*) OVER (PARTITION BY repo_id) AS total FROM files),
d AS (SELECT DISTINCT repo_id, total, array_to_string(p[1:i], '/') AS dir, i FROM (SELECT *, unnest(range(1, len(p))) AS i FROM s))
SELECT repo_id, dir FROM d WHERE i <= CASE WHEN total <= 40 THEN 1000 WHEN total <= 120 THEN 2 ELSE 1 END"""


def p13_section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    kind = F.element_at(F.lit(["file:", "group:config", "group:tests#2", "group:more:helper"]), (F.col("seq") % 4 + 1).cast("int"))
    return f.select("seq", PL.section_label(F.when(kind == "file:", F.concat(kind, "path")).otherwise(kind), F.array("path")).alias("label"))


P13_SQL = f"WITH {FILES_SQL} SELECT seq, [path, 'How the project is set up', 'The tests', 'More helpers'][(seq % 4 + 1)::INT] AS label FROM files"

QUERIES = {
    "g2_language_imports": g2_language_imports, "w3_folder_openings": w3_folder_openings, "t9_folded_flags": t9_folded_flags, "s4_chosen_refs": s4_chosen_refs,
    "s3_fetch_errors": s3_fetch_errors, "s5_archive_entries": s5_archive_entries, "t11_open_folders": t11_open_folders, "p13_section_labels": p13_section_labels,
}
ORACLES = {
    "g2_language_imports": f"SELECT 'r' || (doc_id % 10) AS repo_id, {_kinds_sql(0)} AS src, {_kinds_sql(2)} AS dst FROM documents",
    "w3_folder_openings": W3_SQL, "t9_folded_flags": T9_SQL, "s4_chosen_refs": S4_SQL, "s3_fetch_errors": S3_SQL, "s5_archive_entries": S5_SQL, "t11_open_folders": T11_SQL, "p13_section_labels": P13_SQL,
}
