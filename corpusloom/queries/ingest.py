"""Queries over files: verdicts, filters, limits, trimming, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import constants as C
from corpusloom.functions import paths as P
from corpusloom.operators import ingest as I
from corpusloom.queries.fixture import FILES_SQL, files
from corpusloom.session import read_table


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _any(column: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({column}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


def f1_classify_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = files(spark, sf_dir).withColumn("v", P.path_verdict(F.col("path"), F.col("size")))
    return judged.select("repo_id", "seq", "path", F.coalesce("v.reason", F.lit("keep")).alias("reason"), F.coalesce("v.dir_depth", F.lit(-1)).cast("int").alias("dir_depth"))


_DIR_CASE = "CASE " + " ".join(f"WHEN seg IN {_in(names.split())} THEN '{reason}'" for reason, names in C.SKIPPED_DIRS.items()) + " " + " ".join(f"WHEN ends_with(seg, '{s}') THEN '{r}'" for s, r in C.SKIPPED_DIR_SUFFIXES.items()) + " END"
PARTS_SQL = """parts AS (
  SELECT *, string_split(path, '/') AS segs, lower(list_last(string_split(path, '/'))) AS low, list_last(string_split(path, '/')) AS base,
         lower(regexp_extract(list_last(string_split(path, '/')), '^.+\\.([^.]*)$', 1)) AS ext FROM files)"""
VERDICT_SQL = f"""{FILES_SQL}, {PARTS_SQL},
dirs AS (
  SELECT repo_id, seq, arg_min(reason, i) AS reason, min(i) AS dir_at FROM (
    SELECT repo_id, seq, i, {_DIR_CASE} AS reason FROM (
      SELECT repo_id, seq, unnest(range(len(segs) - 1)) AS i, segs[unnest(range(len(segs) - 1)) + 1] AS seg FROM parts))
  WHERE reason IS NOT NULL GROUP BY repo_id, seq),
verdicts AS (
  SELECT p.repo_id, p.seq, p.path, p.size, p.content, p.segs, d.dir_at,
    coalesce(d.reason, CASE
      WHEN low IN {_in(C.LOCKFILES)} THEN 'lockfile'
      WHEN low IN {_in(C.NOISE_NAMES)} OR ext IN {_in(C.NOISE_EXTENSIONS)} THEN 'cache'
      WHEN low IN {_in(C.HOUSEKEEPING_NAMES)} OR regexp_matches(path, '{C.HOUSEKEEPING_DIRS}') THEN 'housekeeping'
      WHEN low IN {_in(C.SECRET_NAMES)} OR ext IN {_in(C.SECRET_EXTENSIONS)} OR (CASE WHEN low = '.env' OR starts_with(low, '.env.')
        THEN NOT regexp_matches(low, '{C.ENV_TEMPLATE}') ELSE ends_with(low, '.env') END) THEN 'secret'
      WHEN ext IN {_in(C.ASSET_EXTENSIONS)} THEN 'asset'
      WHEN ext IN {_in(C.BINARY_EXTENSIONS)} THEN 'binary'
      WHEN ext IN {_in(C.DATA_FILE_EXTENSIONS)} THEN 'data'
      WHEN regexp_matches(low, '{C.MINIFIED_NAME}') OR ext = 'map' OR regexp_matches(low, '{C.GENERATED_NAME}') OR ends_with(low, '_pb2.py')
        OR low = 'next-env.d.ts' OR ends_with(low, '.tsbuildinfo') THEN 'generated'
      WHEN size = 0 THEN 'empty'
      WHEN size > {C.MAX_FILE_BYTES} THEN CASE WHEN ext IN {_in(C.LARGE_DATA_EXTENSIONS)} THEN 'data' ELSE 'too-large' END
      WHEN ext IN ('json', 'xml') AND size > {C.MAX_DATA_BYTES} THEN 'data' END) AS reason
  FROM parts p LEFT JOIN dirs d ON p.repo_id = d.repo_id AND p.seq = d.seq)"""
F1_SQL = f"WITH {VERDICT_SQL} SELECT repo_id, seq, path, coalesce(reason, 'keep') AS reason, coalesce(dir_at, -1)::INT AS dir_depth FROM verdicts"


def f1_reason_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: documents as files, classified by path and language, counted by repository and reason."""
    judged = files(spark, sf_dir).select("repo_id", "size", P.path_verdict(F.col("path"), F.col("size"))["reason"].alias("reason"), P.language(F.col("path")).alias("language"))
    return judged.groupBy("repo_id", F.coalesce("reason", F.lit("keep")).alias("reason"), "language").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


_LANG_CASE = "CASE " + " ".join(f"WHEN low = '{n}' THEN '{lang}'" for n, lang in C.NAME_LANGUAGES.items()) + " WHEN starts_with(low, 'dockerfile') THEN 'Dockerfile' " + " ".join(f"WHEN ext IN {_in(e.split())} THEN '{lang}'" for lang, e in C.LANGUAGES.items()) + " ELSE 'Text' END"
HIST_SQL = f"""WITH {VERDICT_SQL}
SELECT v.repo_id, coalesce(v.reason, 'keep') AS reason, {_LANG_CASE} AS language, count(*) AS n, sum(v.size)::BIGINT AS bytes
FROM verdicts v JOIN parts p ON v.repo_id = p.repo_id AND v.seq = p.seq GROUP BY ALL"""


def f3_skipped_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.skipped_paths(files(spark, sf_dir))


F3_SQL = f"""WITH {VERDICT_SQL}
SELECT DISTINCT repo_id, array_to_string(segs[1:dir_at + 1], '/') AS path, reason, true AS is_dir FROM verdicts WHERE dir_at IS NOT NULL
UNION ALL SELECT repo_id, path, reason, false FROM verdicts WHERE dir_at IS NULL AND reason IS NOT NULL"""


def f2_secret_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).filter(P.is_secret_name(F.col("path"))).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


F2_SQL = f"""WITH {FILES_SQL}, {PARTS_SQL} SELECT path, count(*) AS n FROM parts
WHERE low IN {_in(C.SECRET_NAMES)} OR ext IN {_in(C.SECRET_EXTENSIONS)} OR (CASE WHEN low = '.env' OR starts_with(low, '.env.')
  THEN NOT regexp_matches(low, '{C.ENV_TEMPLATE}') ELSE ends_with(low, '.env') END) GROUP BY path"""


def p1_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    path = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "^", "./x/../")
    clean = P.normalize_path(path)
    return pages.select("page_id", clean.alias("path"), P.basename(clean).alias("base"), P.dirname(clean).alias("dir"), P.extension(clean).alias("ext"), P.depth(clean).alias("depth"))


P1_SQL = """WITH c AS (SELECT page_id, trim(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+', '/', 'g'), '/') AS path FROM pages)
SELECT page_id, path, regexp_extract(path, '[^/]*$') AS base, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext, (len(string_split(path, '/')) - 1)::INT AS depth FROM c"""


def p3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("seq", P.language(F.col("path")).alias("language"))


P3_SQL = f"WITH {FILES_SQL}, {PARTS_SQL} SELECT seq, {_LANG_CASE} AS language FROM parts"


def p4_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("seq", P.category(F.col("path")).alias("category"))


def _dir_in(names) -> str:
    return f"len(list_intersect(list_transform(segs[1:len(segs) - 1], lambda x: lower(x)), {list(names)!r})) > 0"


_CODE = f"ext IN {_in(C.CODE_EXTENSIONS)}"
_ROUTE = f"""(({_CODE} OR ext = 'html') AND (
  (regexp_matches(lower(path), '(^|/)app/') AND regexp_matches(low, '{C.APP_ROUTE_FILE}'))
  OR (regexp_matches(lower(path), '(^|/)(pages|routes)/') AND NOT regexp_matches(lower(path), '(^|/)(components|lib|utils)/'))
  OR regexp_matches(lower(path), '(^|/)src/routes/') OR regexp_matches(lower(path), '(^|/)server/(api|routes)/')
  OR regexp_matches(lower(path), '{C.SERVER_ROUTE_DIRS}') OR regexp_matches(low, '{C.ROUTE_NAME}') OR regexp_matches(low, '{C.ROUTE_SUFFIX}')))"""
CATEGORY_CASE = f"""CASE
  WHEN {_any("path", C.TEST_PATTERNS)} THEN 'test'
  WHEN low IN {_in(C.CONFIG_NAMES)} OR {_any("low", C.CONFIG_PATTERNS)} OR regexp_matches(path, '{C.CONFIG_DIRS}')
    OR (regexp_matches(path, '{C.INFRA_DIRS}') AND regexp_matches(low, '{C.INFRA_FILE}')) THEN 'config'
  WHEN ext IN {_in(C.DOC_EXTENSIONS)} OR regexp_matches(path, '(?i)(^|/)docs?/') THEN CASE WHEN {_CODE} THEN 'helper' ELSE 'docs' END
  WHEN ext IN {_in(C.STYLE_EXTENSIONS)} OR regexp_matches(low, '\\.css\\.(ts|js)$') THEN 'style'
  WHEN ({_dir_in(C.SCRIPT_DIRS)} AND NOT {_dir_in(C.NOT_SCRIPT_DIRS)}) OR regexp_matches(path, '(?i)^(tools|tooling)/') THEN 'script'
  WHEN ext IN {_in(C.SCRIPT_EXTENSIONS)} THEN 'script'
  WHEN {_dir_in(C.MIGRATION_DIRS)} THEN 'data'
  WHEN {_ROUTE} THEN 'route'
  WHEN ext IN {_in(C.DATA_EXTENSIONS)} THEN CASE WHEN NOT contains(path, '/') OR starts_with(low, '.') OR regexp_matches(low, '^taskfile\\.') THEN 'config' ELSE 'data' END
  WHEN {_dir_in(C.STATIC_DIRS)} AND {_CODE} THEN 'component'
  WHEN ext IN {_in(C.TEMPLATE_EXTENSIONS)} THEN 'component'
  WHEN {_dir_in(C.HELPER_DIRS)} OR regexp_matches(low, '\\.d\\.ts$') OR regexp_matches(low, '{C.HELPER_NAME}') OR regexp_matches(base, '{C.HOOK_NAME}') THEN 'helper'
  WHEN ext IN {_in(C.COMPONENT_EXTENSIONS)} OR {_dir_in(C.COMPONENT_DIRS)} THEN 'component'
  WHEN ext IN ('tsx', 'jsx') AND NOT {_dir_in(C.LOGIC_DIRS)} THEN 'component'
  WHEN {_CODE} OR ext = '' THEN 'core' ELSE 'data' END"""
P4_SQL = f"WITH {FILES_SQL}, {PARTS_SQL} SELECT seq, {CATEGORY_CASE} AS category FROM parts"


def p7_entry_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    main = f.groupBy("repo_id").agg(F.max(F.col("path").rlike(r"^src/(main|index)\.")).alias("src_has_main"))
    return f.join(main, "repo_id").select("seq", P.is_entry_path(F.col("path"), F.col("src_has_main")).alias("is_entry"))


ENTRY_SQL = f"""entries AS (
  SELECT *, regexp_matches(path, '^(src/)?app/(layout|page)\\.(t|j)sx?$') OR regexp_matches(path, '^(src/)?pages/(_app|index)\\.(t|j)sx?$')
    OR regexp_matches(path, '^src/(main|lib)\\.rs$') OR regexp_matches(path, '^cmd/[^/]+/main\\.go$') OR path = 'main.go'
    OR regexp_matches(path, '^lib/main\\.dart$') OR (base = '__main__.py' AND len(segs) <= 3)
    OR (len(segs) = 3 AND segs[1] = 'src' AND regexp_matches(base, '^(main|app|server|cli)\\.py$'))
    OR ({_any("base", C.ENTRY_NAMES)} AND (len(segs) = 1 OR (len(segs) = 2 AND lower(segs[1]) IN {_in(C.ENTRY_PARENTS)}
      AND NOT (lower(segs[1]) = 'lib' AND bool_or(regexp_matches(path, '^src/(main|index)\\.')) OVER (PARTITION BY repo_id))))) AS is_entry
  FROM parts)"""
P7_SQL = f"WITH {FILES_SQL}, {PARTS_SQL}, {ENTRY_SQL} SELECT seq, is_entry FROM entries"


def p8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    main = f.groupBy("repo_id").agg(F.max(F.col("path").rlike(r"^src/(main|index)\.")).alias("src_has_main"))
    f = f.join(main, "repo_id").withColumn("category", P.category(F.col("path"))).withColumn("is_entry", P.is_entry_path(F.col("path"), F.col("src_has_main")) & ~F.col("category").isin("test", "config", "docs"))
    kind = F.when(F.col("is_entry"), "entry").otherwise(F.col("category"))
    lines = F.size(F.split("content", "\n", -1)) * 7
    return f.select("seq", P.importance(F.col("path"), kind, F.col("is_entry"), lines, (F.col("seq") % 9).cast("int"), (F.col("seq") % 8).cast("int")).alias("importance"))


_WEIGHT = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in C.CATEGORY_WEIGHTS.items()) + " END"
P8_SQL = f"""WITH {FILES_SQL}, {PARTS_SQL}, {ENTRY_SQL},
c AS (SELECT *, {CATEGORY_CASE} AS category, len(string_split(content, chr(10))) * 7 AS lines FROM entries),
k AS (SELECT * EXCLUDE (is_entry), is_entry AND category NOT IN ('test', 'config', 'docs') AS entry FROM c),
e AS (SELECT *, CASE WHEN entry THEN 'entry' ELSE category END AS kind FROM k)
SELECT seq, ({_WEIGHT} + CASE WHEN entry THEN 40 ELSE 0 END + least(36, (seq % 8) * 6)
  + least(CASE WHEN kind = 'route' OR entry THEN 24 ELSE 14 END, (seq % 9) * 2)
  + CASE WHEN kind = 'route' AND regexp_matches(path, '(^|/)api/') AND lines > 60 THEN 8 ELSE 0 END
  + CASE WHEN lines >= 20 THEN 8 WHEN lines < 8 THEN -6 ELSE 0 END
  + CASE WHEN lines > 60 THEN least(12, floor(log2(lines / 60.0) * 4 + 0.5)) ELSE 0 END
  - greatest(0, len(segs) - 3) * 2 + CASE WHEN regexp_matches(path, '{C.NAME_SIGNAL}') THEN 4 ELSE 0 END)::INT AS importance FROM e"""


def f4_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    extra = F.when(F.col("doc_id") % 5 == 1, F.lit("a\r\nb\rc")).when(F.col("doc_id") % 5 == 2, F.lit("a\x00b")).otherwise(F.lit(""))
    text = I.decode_text(F.concat(extra, F.col("text")).cast("binary"))
    return docs.select("doc_id", F.coalesce(F.md5(text), F.lit("binary")).alias("text_md5"))


F4_SQL = """SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN 'binary' ELSE md5(replace(replace(CASE WHEN doc_id % 5 = 1 THEN 'a' || chr(13) || chr(10) || 'b' || chr(13) || 'c' ELSE '' END || text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS text_md5 FROM documents"""


def f5_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.lit(" \t\n  ")).when(F.col("doc_id") % 7 == 1, F.lit("")).otherwise(F.col("text"))
    return docs.select("doc_id", (I.is_blank(text)).alias("is_empty"))


F5_SQL = "SELECT doc_id, doc_id % 7 IN (0, 1) OR length(regexp_replace(text, '\\s', '', 'g')) = 0 AS is_empty FROM documents"


def f6_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    text = F.when(k == 0, F.concat(F.lit("// Code generated by a tool. DO NOT EDIT.\n"), "text")).when(k == 1, F.concat(F.repeat(F.lit("x"), 5000), "text")).when(k == 2, F.concat(F.repeat(F.lit("\n"), 7), F.lit("@generated "), F.col("text"))).otherwise(F.col("text"))
    path = F.when(F.col("doc_id") % 12 == 0, F.lit("a.md")).otherwise(F.lit("a.ts"))
    return docs.select("doc_id", I.looks_generated(path, text).alias("is_generated"))


F6_SQL = """WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '// Code generated by a tool. DO NOT EDIT.' || chr(10) || text WHEN 1 THEN repeat('x', 5000) || text
  WHEN 2 THEN repeat(chr(10), 7) || '@generated ' || text ELSE text END AS text FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM t)
SELECT doc_id, (doc_id % 6 = 0 AND doc_id % 12 <> 0) OR (length(text) > 4000 AND list_max(list_transform(lines, lambda x: length(x))) > 2000 AND length(text) / len(lines) > 400) AS is_generated FROM l"""


def f7_arrival_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("repo_id", "seq", F.octet_length("content").cast("long").alias("bytes"), (F.col("seq") % 3 != 0).alias("passes"))
    return I.arrival_limit(f, max_files=20, max_bytes=40_000).select("repo_id", "seq", "over_limit")


F7_SQL = f"""WITH {FILES_SQL}, r AS (SELECT repo_id, seq, sum(CASE WHEN seq % 3 <> 0 THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN seq % 3 <> 0 THEN strlen(content) ELSE 0 END) OVER w AS b
FROM files WINDOW w AS (PARTITION BY repo_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT repo_id, seq, coalesce(n, 0) >= 20 OR coalesce(b, 0) > 40000 AS over_limit FROM r"""

RULES = [("", "*.md\n/docs/\n!README.md\nsrc/components/**\nbig/*.json\n# note\n"), ("src", "utils/\n!components/Card*\nstyles/*.scss\n"), ("src/components", "Card1*\n")]


def f8_ignore_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    repos = f.select("repo_id").distinct()
    listed = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit((d + "/" if d else "") + ".gitignore").alias("path"), F.lit(len(t)).cast("long").alias("size"), F.lit(t).alias("content")) for i, (d, t) in enumerate(RULES)]))
    rules = I.parse_rules(repos.select("repo_id", listed.alias("r")).select("repo_id", "r.*"))
    return I.ignored_paths(f, rules)


F8_SQL = f"""WITH {FILES_SQL} SELECT DISTINCT repo_id, path FROM files WHERE CASE
  WHEN regexp_matches(path, '^src/components/Card1[^/]*$') THEN true
  WHEN regexp_matches(path, '^src/components/Card[^/]*$') THEN false
  WHEN regexp_matches(path, '^src/utils/.+') OR regexp_matches(path, '^src/styles/[^/]*\\.scss$') THEN true
  WHEN regexp_matches(path, '(^|/)README\\.md$') THEN false
  ELSE regexp_matches(path, '\\.md$') OR starts_with(path, 'docs/') OR starts_with(path, 'src/components/') OR regexp_matches(path, '^big/[^/]*\\.json$') END"""


def f11_ignore_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    gone = f.filter("seq % 4 = 0").select("repo_id", "path").distinct()
    kept = f.join(gone, ["repo_id", "path"], "left_anti").select("seq", F.lit("kept").alias("state"))
    return kept.unionByName(f.join(gone, ["repo_id", "path"], "left_semi").select("seq", F.lit("gitignored").alias("state")))


F11_SQL = f"""WITH {FILES_SQL} SELECT seq, CASE WHEN (repo_id, path) IN (SELECT (repo_id, path) FROM files WHERE seq % 4 = 0) THEN 'gitignored' ELSE 'kept' END AS state FROM files"""


def f17_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.readme_paths(files(spark, sf_dir))


F17_SQL = f"""WITH {FILES_SQL}, {PARTS_SQL} SELECT repo_id, arg_min(path, (len(segs), length(path), seq)) AS readme_path FROM parts
WHERE regexp_matches(base, '{C.README_NAME}') GROUP BY repo_id"""


def t2_greedy_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).select("repo_id", "seq", "path", F.octet_length("content").cast("long").alias("bytes"), F.length("content").alias("chars"), (F.col("seq") % 11).cast("int").alias("importance"), (F.col("seq") % 50 == 3).alias("is_readme"))
    return I.greedy_trim(f, 60_000).select("repo_id", "seq", "kept")


T2_SQL = f"""WITH RECURSIVE {FILES_SQL},
r AS (SELECT repo_id, seq, strlen(content) AS bytes, row_number() OVER (PARTITION BY repo_id ORDER BY CASE WHEN seq % 50 = 3 THEN 0 ELSE 1 END, -(seq % 11), length(content), seq) AS k FROM files),
s AS (
  SELECT repo_id, seq, k, bytes <= 60000 AS kept, CASE WHEN bytes <= 60000 THEN bytes ELSE 0 END AS used FROM r WHERE k = 1
  UNION ALL
  SELECT r.repo_id, r.seq, r.k, s.used + r.bytes <= 60000, CASE WHEN s.used + r.bytes <= 60000 THEN s.used + r.bytes ELSE s.used END
  FROM s JOIN r ON r.repo_id = s.repo_id AND r.k = s.k + 1)
SELECT repo_id, seq, kept FROM s"""


def a1_ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    kept = f.filter(P.path_verdict(F.col("path"), F.col("size"))["reason"].isNull())
    return I.ingest_stats(kept, I.skipped_paths(f)).select("repo_id", "included_files", "included_bytes", "skipped_entries", "unlisted_skipped")


A1_SQL = f"""WITH {VERDICT_SQL}, sk AS (SELECT DISTINCT repo_id, array_to_string(segs[1:dir_at + 1], '/') AS path FROM verdicts WHERE dir_at IS NOT NULL
  UNION ALL SELECT repo_id, path FROM verdicts WHERE dir_at IS NULL AND reason IS NOT NULL)
SELECT r.repo_id, (SELECT count(*) FROM verdicts v WHERE v.repo_id = r.repo_id AND reason IS NULL) AS included_files,
  (SELECT coalesce(sum(strlen(content)), 0)::BIGINT FROM verdicts v WHERE v.repo_id = r.repo_id AND reason IS NULL) AS included_bytes,
  (SELECT count(*) FROM sk WHERE sk.repo_id = r.repo_id) AS skipped_entries, greatest((SELECT count(*) FROM sk WHERE sk.repo_id = r.repo_id) - 2500, 0) AS unlisted_skipped
FROM (SELECT DISTINCT repo_id FROM files) r"""


def a2_language_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    f = docs.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("seq"), F.col("lang").alias("language"), F.octet_length("text").alias("bytes"), F.when(F.col("doc_id") % 7 == 0, "docs").otherwise("core").alias("category"))
    return I.language_shares(f)


A2_SQL = """WITH s AS (SELECT source AS repo_id, lang AS language, sum(strlen(text)) AS bytes, min(doc_id) AS first FROM documents WHERE doc_id % 7 <> 0 GROUP BY ALL),
p AS (SELECT *, bytes / sum(bytes) OVER (PARTITION BY repo_id) AS share FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY bytes DESC, first) AS rank FROM p WHERE share >= 0.03)
SELECT repo_id, language, floor(share * 100 + 0.5)::INT AS percent, rank::INT AS rank FROM k WHERE rank <= 5"""


def t3_skip_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.limit_listing(files(spark, sf_dir), 12).select("repo_id", "seq")


T3_SQL = f"WITH {FILES_SQL} SELECT repo_id, seq FROM files QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY seq) <= 12"


def g17_notebooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as the first line of a notebook's notes."""
    docs = read_table(spark, sf_dir, "documents")
    source = F.when(F.col("text").isNotNull(), F.to_json(F.array(F.concat("text", F.lit("\n")), F.lit("two"))))
    raw = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":'), source, F.lit('},{"cell_type":"code","source":"x = '), F.col("doc_id").cast("string"), F.lit('"},{"cell_type":"code","source":" "}]}'))
    return docs.select("doc_id", I.notebook_text(raw).alias("text"))


QUERIES = {
    "f1_classify_path": f1_classify_path, "f1_reason_hist": f1_reason_hist, "f2_secret_names": f2_secret_names, "f3_skipped_dirs": f3_skipped_dirs,
    "f4_decode_text": f4_decode_text, "f5_empty": f5_empty, "f6_generated": f6_generated, "f7_arrival_limit": f7_arrival_limit,
    "f8_ignore_last_match": f8_ignore_last_match, "f11_ignore_anti_join": f11_ignore_anti_join, "f17_readme": f17_readme, "p1_path_parts": p1_path_parts,
    "p3_language": p3_language, "p4_category": p4_category, "p7_entry_paths": p7_entry_paths, "p8_importance": p8_importance,
    "t2_greedy_trim": t2_greedy_trim, "t3_skip_listing": t3_skip_listing, "a1_ingest_stats": a1_ingest_stats, "a2_language_share": a2_language_share,
    "g17_notebooks": g17_notebooks,
}
ORACLES = {
    "f1_classify_path": F1_SQL, "f1_reason_hist": HIST_SQL, "f2_secret_names": F2_SQL, "f3_skipped_dirs": F3_SQL, "f4_decode_text": F4_SQL, "f5_empty": F5_SQL,
    "f6_generated": F6_SQL, "f7_arrival_limit": F7_SQL, "f8_ignore_last_match": F8_SQL, "f11_ignore_anti_join": F11_SQL, "f17_readme": F17_SQL,
    "p1_path_parts": P1_SQL, "p3_language": P3_SQL, "p4_category": P4_SQL, "p7_entry_paths": P7_SQL, "p8_importance": P8_SQL, "t2_greedy_trim": T2_SQL,
    "t3_skip_listing": T3_SQL, "a1_ingest_stats": A1_SQL, "a2_language_share": A2_SQL,
}
