"""Queries over the remaining operators: rule budgets, page and manifest predicates, plan steps, spoken forms, narration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.narrate import assemble as A
from corpusloom.narrate import pipeline as N
from corpusloom.narrate import speech as S
from corpusloom.operators import graph as G
from corpusloom.operators import ingest as I
from corpusloom.operators import links as K
from corpusloom.operators import plan as PL
from corpusloom.queries.fixture import FILES_SQL, files
from corpusloom.queries.narration import PARTS_SQL, _events, _parts, _plan_sql, _planned
from corpusloom.session import read_table
from corpusloom.sources import archive, models
from corpusloom.streaming import run_state as R


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def f9_linguist_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    text = "*.scss linguist-generated\n# *.md linguist-generated\ndb/** linguist-vendored=true\n*.yaml linguist-generated=false\n"
    attributes = f.select("repo_id").distinct().select("repo_id", F.lit(1).cast("long").alias("seq"), F.lit(".gitattributes").alias("path"), F.lit(99).cast("long").alias("size"), F.lit(text).alias("content"))
    return I.ignored_paths(f, I.parse_rules(I.linguist_patterns(attributes)))


def f10_rule_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir)
    lines = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100)), lambda i: F.concat(F.lit("f"), i.cast("string"))), "\n")
    rules = d.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("seq"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/.gitignore")).alias("path"), F.lit(400).cast("long").alias("size"), F.concat(F.lit("# top\n"), lines).alias("content"))
    return I.parse_rules(rules).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))


def f14_page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    path = F.when(k % 3 == 0, "src/icons/a.tsx").when(k % 3 == 1, "web/index.html").otherwise("src/ui/primitives/x.tsx")
    text = F.concat(F.when(k % 2 == 0, F.repeat(F.lit("<path d>\n"), 30)).otherwise(F.lit('<div id="root">')), F.lit("x"))
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", PL.is_mostly_markup(path, text, F.size(F.split(text, "\n"))).alias("markup"), PL.is_host_page(path, text, F.lit(True)).alias("host_page"), PL.is_ui_kit(path).alias("ui_kit"))


def f19_relay_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return pages.select("page_id", F.coalesce(U.relay_target_error(F.col("url")), F.lit("ok")).alias("verdict"))


def g14_declared_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _docs(spark, sf_dir), F.col("doc_id").cast("string")
    repo = F.concat(F.lit("r"), k)
    manifest = d.select(repo.alias("repo_id"), F.lit("package.json").alias("path"), F.concat(F.lit('{"main": "./lib/a'), k, F.lit('", "bin": {"x": "cli.js"}, "scripts": {"start": "node ./srv/run.mjs --port 1"}}')).alias("content"))
    made = [manifest] + [d.select(repo.alias("repo_id"), p.alias("path"), F.lit("").alias("content")) for p in (F.concat(F.lit("lib/a"), k, F.lit(".ts")), F.lit("cli.js"), F.lit("srv/run.mjs"), F.lit("other.js"))]
    whole = made[0]
    for x in made[1:]:
        whole = whole.unionByName(x)
    return G.declared_entries(whole)


def x10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("export const load"), k, F.lit(" = () => SET_PAGE_"), k, F.lit("\nexport { a as pickUp, b }\ndef run_"), k, F.lit("(x):\nclass=\"hero\" 'key_"), k, F.lit("'"))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(K.names_in(text)), " ").alias("names"), F.array_join(F.array_sort(K.exported_names(F.lit("src/widget/index.ts"), text)), " ").alias("exports"))


def x2_spoken_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    return _docs(spark, sf_dir).select("doc_id", X.spoken_name(F.concat(F.lit("react-redux_appCore."), k)).alias("name"), X.slug(F.concat(F.lit("Own Er/Repo--"), k)).alias("slug"), X.mask_key(F.concat(F.lit("sk-abcdef"), k)).alias("masked"), X.truncate(F.lit("a  b\nc d e"), 5).alias("short"), X.end_sentence(F.concat(F.lit(" Title "), k)).alias("sentence"))


def x3_polish(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("Notice that the list "), k, F.lit(" grows. It simply works, as you can see. In short: it saves at the bottom of this file."))
    return _docs(spark, sf_dir).select("doc_id", S.speakable_udf(text).alias("spoken"))


def x4_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.normalise_paragraphs(F.concat("text", F.lit("\n\n\n  last\nline ")))).alias("text_md5"))


def x17_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id").cast("string")
    raw = F.concat(F.when(F.col("page_id") % 2 == 0, "https://").otherwise(""), F.lit("api"), k, F.lit(".x.com/v1"), F.when(F.col("page_id") % 3 == 0, "/chat/completions").otherwise("//"))
    base = U.normalise_base_url(raw)
    return read_table(spark, sf_dir, "pages").select("page_id", base.alias("base"), U.chat_endpoint(base).alias("endpoint"))


def l5_tier_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comparators: tiers, importers, lines and reach vary by id, a third of the files is never reached."""
    k = F.col("seq")
    f = _planned(spark, sf_dir).groupBy("repo_id", "path").agg(F.min("seq").alias("seq"))
    f = f.select(
        "repo_id", "path", F.element_at(F.lit(["entry", "route", "core", "component", "helper"]), (k % 5 + 1).cast("int")).alias("tier_kind"), (k % 97).cast("int").alias("importance"),
        (k % 13 * 5).cast("int").alias("lines"), (k % 4).cast("int").alias("n_importers"), F.when(k % 3 > 0, (k * 7 % 101).cast("int")).alias("reach"),
    )
    return PL.tier_order(f).select("repo_id", "path", "ord")


L5_SQL = r"""u AS (SELECT repo_id, path, min(seq) AS seq FROM planned GROUP BY ALL),
f AS (SELECT repo_id, path, ['entry', 'route', 'core', 'component', 'helper'][(seq % 5 + 1)::INT] AS kind, seq % 97 AS importance, seq % 13 * 5 AS lines, seq % 4 AS n, CASE WHEN seq % 3 > 0 THEN seq * 7 % 101 END AS reach,
  CASE WHEN contains(path, '/') THEN array_to_string(string_split(regexp_replace(path, '/[^/]*$', ''), '/')[1:2], '/') ELSE '' END AS folders FROM u),
k AS (SELECT *, kind = 'component' AND reach IS NULL AS late, CASE WHEN kind IN ('entry', 'route') OR (kind = 'component' AND reach IS NOT NULL) THEN '' ELSE folders END AS cluster,
  CASE kind WHEN 'entry' THEN CASE WHEN regexp_matches(path, '(^|/)layout\.[jt]sx?$') THEN 0 WHEN regexp_matches(path, '(^|/)page\.[jt]sx?$') THEN 1 WHEN regexp_matches(path, '\.html?$') THEN 3 ELSE 2 END
    WHEN 'route' THEN (regexp_matches(path, '(^|/)api/') OR regexp_matches(path, '(^|/)route\.[jt]s$'))::INT ELSE 0 END AS k1,
  CASE WHEN kind IN ('entry', 'component') THEN coalesce(reach, 2147483647) ELSE 0 END AS k2, CASE WHEN kind = 'core' THEN -(n * CASE WHEN lines >= 15 THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END) ELSE 0 END AS k3, CASE WHEN kind = 'route' THEN 0 ELSE -importance END AS k4 FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY repo_id, kind, late, cluster ORDER BY k1, k2, k3, k4, path) AS i, max(importance) OVER (PARTITION BY repo_id, kind, late, cluster) AS top FROM k),
l AS (SELECT *, first_value(path) OVER (PARTITION BY repo_id, kind, late, cluster ORDER BY i) AS lead FROM i)
SELECT repo_id, path, (row_number() OVER (PARTITION BY repo_id, kind ORDER BY late, top DESC, lead, i))::INT AS ord FROM l"""


def l8_group_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = PL.group_sections(PL.split_groups(_planned(spark, sf_dir)))
    return g.select("repo_id", "section_id", "chapter", F.size("paths").alias("n"), F.get("paths", 0).alias("first"))


def l8_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _planned(spark, sf_dir).withColumn("repo_id", F.lit("r")).withColumn("path", F.concat(F.lit("d"), (F.col("seq") % 7).cast("string"), F.lit("/f"), F.col("seq").cast("string")))
    out = PL.overflow_sections(f.withColumn("category", F.when(F.col("seq") % 2 == 0, "core").otherwise("helper")))
    return out.select("section_id", F.size("paths").alias("n"), F.get("paths", 0).alias("first"))


L8_OVERFLOW_SQL = f"""WITH {_plan_sql()}, c AS (SELECT seq, importance, CASE WHEN seq % 2 = 0 THEN 'core' ELSE 'helper' END AS cat, 'd' || (seq % 7) AS cl, 'd' || (seq % 7) || '/f' || seq AS p FROM planned),
m AS (SELECT *, count(*) OVER (PARTITION BY cat) AS n, count(*) OVER (PARTITION BY cat, cl) AS m, min(seq) OVER (PARTITION BY cat, cl) AS f FROM c),
r AS (SELECT *, dense_rank() OVER (PARTITION BY cat ORDER BY m DESC, f) AS c, row_number() OVER (PARTITION BY cat, cl ORDER BY seq) - 1 AS i FROM m),
s AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN n <= 16 THEN 'group:more:' || cat WHEN m >= 4 AND c <= 4 THEN 'group:more:' || cat || ':' || cl || ':' || (i // 16 * 16) ELSE 'group:more:' || cat || ':rest' END AS section_id FROM r)
SELECT section_id, count(*)::INT AS n, arg_min(p, (-importance, p)) AS first FROM s GROUP BY section_id"""


def l11_merge_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select(F.col("conv").alias("repo_id"), F.col("part").alias("ord"), F.when(F.col("part") == 1, "support").when(F.col("part") < 4, "setup").otherwise("core").alias("chapter"))
    return PL.merge_small_chapters(p)


def l12_split_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("section_id"), F.lit("interface").alias("chapter"), F.col("doc_id").cast("int").alias("ord"), (F.col("doc_id") % 5 == 0).alias("is_screen"))
    return PL.split_long_chapters(d).groupBy("repo_id", "chapter").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


L12_SQL = """WITH RECURSIVE d AS (SELECT source, doc_id, doc_id % 5 = 0 OR row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS starts FROM documents),
r AS (SELECT *, sum(starts::INT) OVER (PARTITION BY source ORDER BY doc_id) AS run, count(*) OVER (PARTITION BY source) AS total FROM d),
k AS (SELECT source, run, count(*) AS k, min(doc_id) AS first, any_value(total) AS total FROM r GROUP BY source, run),
f AS (SELECT source, run, k AS held, 1 AS g FROM k WHERE run = 1
  UNION ALL SELECT k.source, k.run, CASE WHEN f.held >= 3 AND f.held + k.k > 8 THEN k.k ELSE f.held + k.k END, f.g + (f.held >= 3 AND f.held + k.k > 8)::INT FROM f JOIN k ON k.source = f.source AND k.run = f.run + 1),
l AS (SELECT source, arg_max(held, run) AS held, max(g) AS g FROM f GROUP BY source),
z AS (SELECT k.*, CASE WHEN k.total <= 10 THEN 1 WHEN l.held < 3 AND l.g > 1 AND f.g = l.g THEN f.g - 1 ELSE f.g END AS g FROM k JOIN f USING (source, run) JOIN l ON l.source = k.source)
SELECT source AS repo_id, 'interface' || CASE WHEN g > 1 THEN ':' || g ELSE '' END AS chapter, sum(k)::BIGINT AS n, min(first)::INT AS first FROM z GROUP BY source, g"""


def t6_drop_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _docs(spark, sf_dir).select(F.col("source").alias("repo_id"), F.col("doc_id").cast("int").alias("ord"), F.col("doc_id").cast("string").alias("section_id"), F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")).alias("paths"), (F.col("doc_id") % 3 == 0).alias("is_overflow"))
    return PL.drop_excess(s, 30).select("section_id")


def t12_elide(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda i: F.concat(F.lit("p"), i.cast("string")))
    return _docs(spark, sf_dir).select("doc_id", PL.elide(items, 3).alias("shown"), PL.tour_minutes(F.col("doc_id") * 37).alias("minutes"))


def n6_narrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _parts(spark, sf_dir).select(F.col("conv").cast("string").alias("run_key"), F.concat(F.lit("s"), F.col("part").cast("string")).alias("section_id"), F.col("part").cast("int").alias("ord"), F.concat(F.lit("part"), F.col("part").cast("string")).alias("label"), F.array("body").alias("chunks"), F.lit(50).alias("lo"), F.lit(90).alias("hi"))
    return N.narrate(s, N.StubWriter()).select("run_key", "section_id", "status", "title")


def n11_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select(F.col("conv").cast("string").alias("run_key"), F.concat(F.lit("s"), F.col("part").cast("string")).alias("section_id"), "part")
    done = p.select("run_key", "section_id", F.when(F.col("part") % 2 == 0, "done").otherwise("failed").alias("status"))
    return N.unfinished(p, done).select("run_key", "section_id")


def n10_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select("conv", F.col("part").alias("ord"), F.lit("a").alias("chapter"), F.lit("").alias("chapter_title"), F.lit("").alias("bridge"), F.concat(F.lit("Turn "), F.col("part").cast("string")).alias("title"), "body", F.array(F.lit("x.ts"), F.lit("y.ts")).alias("paths"))
    tours = p.select("conv").distinct().select("conv", F.lit("Demo").alias("title"), F.lit("[o/r](u)").alias("link"), F.lit("m").alias("model"), F.lit("2024-03-05").cast("timestamp").alias("created_at"), F.lit("All.").alias("overview"), F.lit("").alias("closing"), F.array().cast("array<string>").alias("missing"))
    return A.markdown(p, tours)


def a14_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("type", F.element_at(F.lit(["section-start", "section-done", "section-failed"]), (F.col("seq") % 3 + 1).cast("int")))
    return R.progress(R.latest_states(e))


def s8_subpath(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.inside(files(spark, sf_dir), "src/components/").select("repo_id", "seq", "path")


def s11_model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    body = F.concat(F.lit('{"data":[{"id":"z'), k, F.lit('"},{"id":"a'), k, F.lit('"},{"name":"x"}]}'))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(models.model_ids(body), " ").alias("ids"))


QUERIES = {
    "f9_linguist_hints": f9_linguist_hints, "f10_rule_budget": f10_rule_budget, "f14_page_predicates": f14_page_predicates, "f19_relay_targets": f19_relay_targets,
    "g14_declared_entries": g14_declared_entries, "x10_names": x10_names, "x2_spoken_tokens": x2_spoken_tokens, "x3_polish": x3_polish, "x4_paragraphs": x4_paragraphs,
    "x17_endpoints": x17_endpoints, "l5_tier_order": l5_tier_order, "l8_group_sections": l8_group_sections, "l8_overflow": l8_overflow,
    "l11_merge_chapters": l11_merge_chapters, "l12_split_chapters": l12_split_chapters, "t6_drop_excess": t6_drop_excess, "t12_elide": t12_elide,
    "n6_narrate": n6_narrate, "n11_resume": n11_resume, "n10_markdown": n10_markdown, "a14_progress": a14_progress, "s8_subpath": s8_subpath,
    "s11_model_list": s11_model_list,
}
ORACLES = {
    "l8_overflow": L8_OVERFLOW_SQL,
    "l12_split_chapters": L12_SQL,
    "f9_linguist_hints": f"WITH {FILES_SQL} SELECT DISTINCT repo_id, path FROM files WHERE ends_with(path, '.scss') OR starts_with(path, 'db/')",
    "f10_rule_budget": "SELECT source AS repo_id, least(3000, 100 * count(*)) AS n FROM documents GROUP BY source",
    "f14_page_predicates": """SELECT page_id, page_id % 3 = 0 OR page_id % 2 = 0 AS markup, page_id % 3 = 1 AND page_id % 2 = 1 AS host_page, page_id % 3 = 2 AS ui_kit FROM pages""",
    "f19_relay_targets": "SELECT page_id, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'scheme' WHEN contains(url, '?') OR contains(url, '#') THEN 'query' ELSE 'ok' END AS verdict FROM pages",
    "g14_declared_entries": "SELECT 'r' || doc_id AS repo_id, unnest(['lib/a' || doc_id || '.ts', 'cli.js', 'srv/run.mjs']) AS path FROM documents",
    "x10_names": "SELECT doc_id, array_to_string(list_sort(['SET_PAGE_' || doc_id, 'pickUp', 'key_' || doc_id]), ' ') AS names, array_to_string(list_sort(['load' || doc_id, 'pickUp', 'run_' || doc_id, 'widget']), ' ') AS exports FROM documents",
    "x2_spoken_tokens": "SELECT doc_id, 'react redux app Core ' || doc_id AS name, 'own-er-repo-' || doc_id AS slug, 'sk-a…' || right('sk-abcdef' || doc_id, 4) AS masked, 'a b c…' AS short, 'Title ' || doc_id || '.' AS sentence FROM documents",
    "x3_polish": "SELECT doc_id, 'The list ' || doc_id || ' grows. It works. It saves toward the end of the file.' AS spoken FROM documents",
    "x4_paragraphs": r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split_regex(text || chr(10) || chr(10) || chr(10) || '  last' || chr(10) || 'line ', '\n{2,}'), lambda p: trim(regexp_replace(p, '\n+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10))) AS text_md5 FROM documents",
    "x17_endpoints": "SELECT page_id, 'https://api' || page_id || '.x.com/v1' AS base, 'https://api' || page_id || '.x.com/v1/chat/completions' AS endpoint FROM pages",
    "l5_tier_order": f"WITH {_plan_sql()}, {L5_SQL}",
    "l8_group_sections": f"""WITH {_plan_sql()} SELECT repo_id, 'group:' || group_kind AS section_id, CASE group_kind WHEN 'ui-kit' THEN 'interface' WHEN 'migrations' THEN 'core' WHEN 'config' THEN 'setup' WHEN 'tests' THEN 'setup' WHEN 'docs' THEN 'setup' ELSE 'support' END AS chapter,
      least(90, count(*))::INT AS n, arg_min(path, (-importance, path)) AS first FROM groups WHERE group_kind IS NOT NULL GROUP BY repo_id, group_kind""",
    "l11_merge_chapters": f"""WITH {PARTS_SQL}, c AS (SELECT conv AS repo_id, part AS ord, CASE WHEN part = 1 THEN 'support' WHEN part < 4 THEN 'setup' ELSE 'core' END AS chapter FROM parts),
      n AS (SELECT *, count(*) FILTER (chapter = 'support') OVER (PARTITION BY repo_id) AS s, count(*) FILTER (chapter = 'setup') OVER (PARTITION BY repo_id) AS t FROM c)
      SELECT repo_id, ord, CASE WHEN chapter = 'support' AND s > 0 AND t > 0 AND (s = 1 OR t = 1) THEN 'setup' ELSE chapter END AS chapter FROM n""",
    "t6_drop_excess": """WITH s AS (SELECT source, doc_id, doc_id % 4 + 1 AS n, doc_id % 3 = 0 AS o, count(*) OVER (PARTITION BY source) AS total FROM documents),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, o ORDER BY n, doc_id) AS k FROM s) SELECT doc_id::VARCHAR AS section_id FROM r WHERE NOT (o AND k <= total - 30)""",
    "t12_elide": "SELECT doc_id, CASE WHEN doc_id % 5 + 1 > 3 THEN 'p1, p2, p3 and ' || (doc_id % 5 - 2) || ' more' ELSE array_to_string(list_transform(range(1, doc_id % 5 + 2), lambda i: 'p' || i), ', ') END AS shown, greatest(5, floor(doc_id * 37 / 150.0::DOUBLE / 5 + 0.5) * 5)::INT AS minutes FROM documents",
    "n6_narrate": "SELECT conv_id::VARCHAR AS run_key, 's' || turn AS section_id, 'done' AS status, 'part' || turn AS title FROM conversations",
    "n11_resume": "SELECT conv_id::VARCHAR AS run_key, 's' || turn AS section_id FROM conversations WHERE turn % 2 = 1",
    "n10_markdown": f"""WITH {PARTS_SQL}, n AS (SELECT conv, part, body, row_number() OVER (PARTITION BY conv ORDER BY part) AS k FROM parts),
      b AS (SELECT conv, string_agg('## ' || k || '. Turn ' || part || chr(10) || chr(10) || '`x.ts` · `y.ts`' || chr(10) || chr(10) || trim(body), chr(10) || chr(10) ORDER BY part) AS t FROM n GROUP BY conv)
      SELECT conv, '# Demo' || chr(10) || chr(10) || '*A spoken walkthrough of [o/r](u), written with `m` on March 5, 2024.*' || chr(10) || chr(10) || '## The big picture' || chr(10) || chr(10) || 'All.' || chr(10) || chr(10) || t || chr(10) AS markdown FROM b""",
    "a14_progress": """WITH l AS (SELECT user_id % 50 AS run_id, user_id, ['section-start', 'section-done', 'section-failed'][(max(event_id) % 3 + 1)::INT] AS s FROM events GROUP BY ALL)
      SELECT run_id, count(*) FILTER (s = 'section-start') AS n_section_start, count(*) FILTER (s = 'section-done') AS n_section_done, count(*) FILTER (s = 'section-failed') AS n_section_failed, count(*) AS n_sections FROM l GROUP BY run_id""",
    "s8_subpath": f"WITH {FILES_SQL} SELECT repo_id, seq, substr(path, 16) AS path FROM files WHERE starts_with(path, 'src/components/')",
    "s11_model_list": "SELECT doc_id, 'a' || doc_id || ' z' || doc_id AS ids FROM documents",
}
