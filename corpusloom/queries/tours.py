"""Queries over whole tours: manifests and terms, spoken names, related code, revised and framed narration.

Inputs vary by id: several shapes of manifest, path and part, with the real texts in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.narrate import pipeline as N
from corpusloom.operators import graph as G
from corpusloom.operators import links as K
from corpusloom.operators import related as RL
from corpusloom.operators import stack as ST
from corpusloom.queries.fixture import FILES_SQL, files
from corpusloom.queries.narration import PARTS_SQL, _parts
from corpusloom.session import read_table


def _nth(k: Column, *cases) -> Column:
    """The case that the remainder of k by their number picks."""
    out = cases[-1]
    for i, case in reversed(list(enumerate(cases[:-1]))):
        out = F.when(k % len(cases) == i, case).otherwise(out)
    return out


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents a repository: six kinds of manifest, and the text itself."""
    k = F.col("doc_id")
    n = k.cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = _nth(k, F.lit("package.json"), F.lit("api/requirements-dev.txt"), F.lit("pyproject.toml"), F.lit("go.mod"), F.lit("Cargo.toml"), F.lit("Gemfile"), F.lit("notes.txt"))
    text = _nth(
        k,
        say('{"dependencies": {"react": "1", "lib-', n, '": "2"}, "devDependencies": {"jest": "1"}}'),
        say("# tools\nFlask==2.0\n-r base.txt\n  Lib_", n, ">=1\n"),
        say('[project]\ndependencies = [\n  "Django>=4",\n  "lib', n, '",\n]\n'),
        say("module x\nrequire (\n\tgithub.com/a/b", n, " v1.2.3\n\tgithub.com/c/d v0.1.0 // indirect\n)\n"),
        say('[package]\nname = "x"\n[dependencies]\nserde = "1"\nlib-', n, ' = "2"\n[dev-dependencies]\nother = "1"\n'),
        say('source "x"\ngem "rails"\n  gem \'lib-', n, "'\n"),
        F.coalesce("text", F.lit("")),
    )
    return read_table(spark, sf_dir, "documents").select(F.floor(k / 7).cast("long").cast("string").alias("repo_id"), k.alias("seq"), path.alias("path"), text.alias("content"))


def g16_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.manifest_dependencies(_manifests(spark, sf_dir))


G16_SQL = """WITH d AS (SELECT doc_id // 7 AS r, doc_id AS k FROM documents),
n AS (SELECT r::VARCHAR AS repo_id, k, unnest(CASE k % 7 WHEN 0 THEN ['react', 'lib-' || k] WHEN 1 THEN ['flask', 'lib_' || k] WHEN 2 THEN ['django', 'lib' || k]
  WHEN 3 THEN ['github.com/a/b' || k] WHEN 4 THEN ['serde', 'lib-' || k] WHEN 5 THEN ['rails', 'lib-' || k] ELSE [] END) AS dep, unnest(range(CASE k % 7 WHEN 3 THEN 1 WHEN 6 THEN 0 ELSE 2 END)) AS pos FROM d)
SELECT repo_id, dep, row_number() OVER (PARTITION BY repo_id ORDER BY k, pos)::INT AS ord FROM n"""


X13_CODE = (
    "useState(1); dispatch (x);", "connect(a); const slug = 1; a.then(b);", "notes", "componentDidMount() {} dispatch(y); payload", "createContext(0); run migrations; connect (b)", "notes",
    "app.get (x); new Promise; slug payload", "dispatch(z); @app.route; a migration; connect(c)", "notes", "router.post(x); createContext (1); componentWillUnmount; slug", "useIt(); .then (c); app.put(x)",
)
_X13_CODE = "[" + ", ".join(f"'{x}'" for x in X13_CODE) + f"][(doc_id % {len(X13_CODE)} + 1)::INT]"


def x13_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of repositories of seven documents whose dependencies and code vary; the documents' texts are in the code."""
    k = F.col("doc_id")
    r = F.floor(k / 7).cast("long")
    code = F.concat(_nth(k, *[F.lit(x) for x in X13_CODE]), F.lit("\n"), F.coalesce("text", F.lit("")))
    docs = read_table(spark, sf_dir, "documents").select(r.alias("repo"), r.cast("string").alias("repo_id"), k.alias("seq"), F.concat(F.lit("src/m"), k.cast("string"), _nth(k, F.lit(".ts"), F.lit(".ts"), F.lit(".md"))).alias("path"), code.alias("content"))
    deps = docs.groupBy("repo", "repo_id").agg(F.min("seq").alias("ord")).select("repo_id", _nth(F.col("repo"), F.lit("react"), F.lit("vuex"), F.lit("@ai-sdk/x"), F.lit("none")).alias("dep"), "ord")
    terms = ST.core_terms(docs, deps)
    return terms.groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term"))), lambda x: x["term"]), ", ").alias("terms"))


#: Fixed values, typed here and not taken from the operator: jargon in order, each with its pattern.
_JARGON = (
    ("dispatch", r"\bdispatch\s*\("), ("connect", r"\bconnect\s*\("), ("slug", r"\bslug\b"), ("payload", r"\bpayload\b"), ("promise", r"\bPromise\b|\.then\s*\("),
    ("lifecycle method", r"\bcomponent(Did|Will)(Mount|Update|Unmount|ReceiveProps)\b"), ("context", r"\bcreateContext\s*\("), ("migration", r"\bmigrations?\b"),
    ("endpoint", r"\bapp\.(get|post|put|delete)\s*\(|@app\.(get|post|route)\b|\brouter\.(get|post)\s*\("),
)
X13_SQL = rf"""WITH d AS (SELECT doc_id // 7 AS r, doc_id AS k, doc_id % 3 = 2 AS md, {_X13_CODE} || chr(10) || coalesce(text, '') AS t FROM documents),
c AS (SELECT r, bool_or(NOT md AND regexp_matches(t, '\buse[A-Z]\w*\s*\(')) AS hook,
  list_filter([{", ".join(f"CASE WHEN count(*) FILTER (NOT md AND regexp_matches(t, '{p}')) >= 3 THEN '{t}' END" for t, p in _JARGON)}], lambda x: x IS NOT NULL) AS jargon FROM d GROUP BY r),
l AS (SELECT r, list_concat(CASE r % 4 WHEN 0 THEN list_concat(['component', 'props', 'state'], CASE WHEN hook THEN ['hook'] ELSE [] END) WHEN 1 THEN ['store'] WHEN 2 THEN ['prompt', 'model', 'streaming'] ELSE [] END, jargon) AS t FROM c)
SELECT r::VARCHAR AS repo_id, array_to_string(t[1:12], ', ') AS terms FROM l WHERE len(t) > 0"""


def x13_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("<!-- hidden\nlines -->\n[![badge](a.svg)](b) <img src='x'>\n<div align='center'>Logo "), k, F.lit("</div>\n\n\n\nSee [docs](http://x/"), k, F.lit(").&nbsp;A &amp; B\n"), F.coalesce("text", F.lit("")))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(ST.clean_readme(raw)).alias("clean_md5"))


def l15_spoken_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of paths of eight shapes, some of which sound alike within a repository."""
    k = F.col("doc_id")
    n, m = k.cast("string"), (F.floor(k / 8) % 2).cast("long").cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    path = _nth(k, say("src/reducer.js"), say("src/reducers/articleList", n, ".js"), say("src/components/Card", n, "/index.js"), say("src/components/Box", n, "/SubmitButton", n, ".js"), say("src/agent", n, ".js"), say("src/constants/actionTypes", n, ".js"), say("lib", m, "/helpers.ts"), say("web/index.html"))
    docs = read_table(spark, sf_dir, "documents").select("source", path.alias("path"))
    return ST.spoken_names(docs.select(F.lit("r").alias("repo_id"), "path")).select("path", "spoken")


L15_SQL = """WITH p AS (SELECT DISTINCT doc_id AS k, (doc_id // 8) % 2 AS m FROM documents),
x AS (SELECT k % 8 AS s, k, m FROM p),
n AS (SELECT DISTINCT CASE s WHEN 0 THEN 'src/reducer.js' WHEN 1 THEN 'src/reducers/articleList' || k || '.js' WHEN 2 THEN 'src/components/Card' || k || '/index.js' WHEN 3 THEN 'src/components/Box' || k || '/SubmitButton' || k || '.js'
  WHEN 4 THEN 'src/agent' || k || '.js' WHEN 5 THEN 'src/constants/actionTypes' || k || '.js' WHEN 6 THEN 'lib' || m || '/helpers.ts' ELSE 'web/index.html' END AS path,
  CASE s WHEN 0 THEN 'the top-level reducer file' WHEN 1 THEN 'the article list' || k || ' reducer' WHEN 2 THEN 'the Card' || k || ' component' WHEN 3 THEN 'the Submit Button' || k || ' component'
  WHEN 4 THEN 'the agent' || k || ' file' WHEN 5 THEN 'the action types' || k || ' file' WHEN 6 THEN 'the helpers file in the lib' || m || ' folder' ELSE 'the HTML page' END AS spoken FROM x)
SELECT path, spoken FROM n"""


def a17_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return ST.tests_fact(f.select("repo_id", F.when(F.col("path").rlike(r"^tests/"), "test").otherwise("core").alias("category")))


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files that share names with those of one group, import the next one, and hold the documents' texts; edges; rare names."""
    k = F.col("doc_id")
    group = F.floor(k / 4).cast("long")
    n = k.cast("string")
    lines = F.concat(F.lit("import { load"), (k + 1).cast("string"), F.lit(" } from './m"), (k + 1).cast("string"), F.lit("';\nexport function load"), n, F.lit("() {\n  return SHARED_NAME_"), group.cast("string"), F.lit(";\n}\n\n\n\nload"), (k + 1).cast("string"), F.lit("();\n"), F.coalesce("text", F.lit("")))
    f = read_table(spark, sf_dir, "documents").select(F.floor(k / 60).cast("long").cast("string").alias("repo_id"), k.alias("seq"), F.concat(F.lit("src/m"), n, F.lit(".ts")).alias("path"), _nth(k, F.lit("core"), F.lit("component")).alias("category"), lines.alias("content"))
    next_ = f.select("repo_id", F.concat(F.lit("src/m"), (F.col("seq") - 1).cast("string"), F.lit(".ts")).alias("src"), F.col("path").alias("dst"))
    edges = next_.join(f.select("repo_id", F.col("path").alias("src")), ["repo_id", "src"], "left_semi")
    sizes = f.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_code"))
    return f, edges, K.rare_names(K.postings(f.select("repo_id", "path", "category", "content")), sizes)


def t7_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, edges, rare = _code(spark, sf_dir)
    return RL.related_excerpts(f, rare, edges)


def n14_group_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, edges, rare = _code(spark, sf_dir)
    sections = f.groupBy("repo_id", (F.floor(F.col("seq") / 10)).alias("g")).agg(F.array_sort(F.collect_list("path")).alias("paths")).select("repo_id", F.concat(F.lit("group:"), F.col("g").cast("string")).alias("section_id"), "paths")
    return RL.group_excerpts(sections, f, rare, edges, 5000)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    return p.select(
        F.concat(F.lit("o|r"), F.col("conv").cast("string")).alias("run_key"), F.concat(F.lit("s"), F.col("part").cast("string")).alias("section_id"), F.col("part").cast("int").alias("ord"),
        F.concat(F.lit("part"), F.col("part").cast("string")).alias("label"), F.array("body").alias("chunks"), F.lit(50).alias("lo"), F.lit(90).alias("hi"), "chapter", F.lit(None).cast("string").alias("chapter_title"), F.array(F.lit("x.ts")).alias("paths"),
    )


class FixedWriter:
    """Fails on some parts, names chapters in the overview, and shortens every second part too much when it revises."""

    def __call__(self, system: str, prompt: str, max_tokens: int) -> str:
        part = prompt.split("\n", 1)[0].removeprefix("Part: ")
        if part == "Overview":
            return "NAME: Demo\nAll of it.\nCHAPTER 1: Opening\nCHAPTER 2: Going on\nBRIDGE 2: And then."
        if part == "Closing":
            return "The end of it."
        if part.endswith("3"):
            raise N.WriterError("other")
        if "Write the part again" in prompt:
            return f"TITLE: {part}\n" + ("Short." if part.endswith("1") else "Revised words of it here.")
        return f"TITLE: {part}\nWords of the first draft here.\nSUMMARY: On {part}."


def n6_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = N.narrate(_sections(spark, sf_dir), FixedWriter())
    flags = drafts.select("run_key", "section_id", F.lit("too long").alias("flag"))
    return N.revise(drafts, flags, FixedWriter()).select("run_key", "section_id", "status", "body")


def n7_run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    status = F.when(F.col("conv") % 3 == 0, F.when(F.col("part") % 2 == 0, "done").otherwise("failed")).when(F.col("conv") % 3 == 1, F.when(F.col("part") % 3 == 0, "done").otherwise("failed")).otherwise(F.when(F.col("part") == 0, "failed").otherwise("skipped"))
    return N.run_states(p.select(F.col("conv").cast("string").alias("run_key"), status.alias("status")))


N7_SQL = """WITH s AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN CASE WHEN turn % 2 = 0 THEN 'done' ELSE 'failed' END WHEN 1 THEN CASE WHEN turn % 3 = 0 THEN 'done' ELSE 'failed' END ELSE CASE WHEN turn = 0 THEN 'failed' ELSE 'skipped' END END AS s FROM conversations),
c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (s = 'done') AS d, count(*) FILTER (s = 'skipped') AS k FROM s GROUP BY conv_id)
SELECT conv_id::VARCHAR AS run_key, n AS n_sections, d AS n_done, CASE WHEN k > 0 THEN 'stopped' WHEN d > 0 AND d * 2 >= n THEN 'complete' ELSE 'failed' END AS status FROM c"""


def n8_named_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sections(spark, sf_dir)
    results = N.narrate(s, FixedWriter())
    parts = N.named_parts(results, s, N.frame_tours(results, FixedWriter()))
    return parts.select("conv", "section_id", "chapter_title", "bridge", "title")


def _stored(texts: DataFrame) -> DataFrame:
    """Rows that a writer is asked for once, from a table. By its files a table of like texts looks far smaller than it is, so
    the planner is told to merge and not to broadcast it."""
    return G.checkpointed(texts).hint("merge")


def n9_walkthroughs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and frames are read more than once, and asked for once."""
    s = _sections(spark, sf_dir)
    results = _stored(N.narrate(s, FixedWriter()))
    frames = _stored(N.frame_tours(results, FixedWriter()))
    out = N.walkthroughs(s, N.named_parts(results, s, frames), frames)
    return out.select("conv", "name", "title", "overview", "closing", F.size("parts").alias("n_parts"), F.array_join("missing", ", ").alias("missing"))


#: Parts as the writer leaves them: part 3, 13 and so on fail.
_WRITTEN = f"""WITH {PARTS_SQL}, w AS (SELECT 'o|r' || conv AS run_key, part, chapter, part::VARCHAR LIKE '%3' AS failed FROM parts),
ok AS (SELECT run_key FROM w GROUP BY run_key HAVING count(*) FILTER (NOT failed) > 0 AND count(*) FILTER (NOT failed) * 2 >= count(*))"""
_NAMED = f"""{_WRITTEN}, d AS (SELECT w.* FROM w JOIN ok USING (run_key) WHERE NOT failed),
f AS (SELECT *, lag(chapter) OVER o IS DISTINCT FROM chapter OR lag(part) OVER o IS NULL AS first FROM d WINDOW o AS (PARTITION BY run_key ORDER BY part)),
r AS (SELECT *, sum(first::INT) OVER (PARTITION BY run_key ORDER BY part) AS run FROM f)"""

QUERIES = {
    "g16_manifests": g16_manifests, "x13_terms": x13_terms, "x13_readme": x13_readme, "l15_spoken_names": l15_spoken_names, "a17_tests": a17_tests, "t7_related": t7_related,
    "n14_group_excerpts": n14_group_excerpts, "n6_revised": n6_revised, "n7_run_states": n7_run_states, "n8_named_parts": n8_named_parts, "n9_walkthroughs": n9_walkthroughs,
}
ORACLES = {
    "g16_manifests": G16_SQL,
    "x13_terms": X13_SQL,
    "x13_readme": r"""WITH t AS (SELECT doc_id, chr(10) || ' ' || chr(10) || ' Logo ' || doc_id || ' ' || chr(10) || chr(10) || 'See docs. A & B' || chr(10) || coalesce(text, '') AS t FROM documents),
      c AS (SELECT doc_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS c FROM t), s AS (SELECT doc_id, regexp_replace(regexp_replace(c, '^[\s\x0B]+', ''), '[\s\x0B]+$', '') AS s FROM c)
      SELECT doc_id, md5(CASE WHEN length(s) > 2600 THEN s[1:2600] || chr(10) || '[README continues]' ELSE s END) AS clean_md5 FROM s""",
    "l15_spoken_names": L15_SQL,
    "a17_tests": f"""WITH {FILES_SQL}, c AS (SELECT repo_id, count(*) FILTER (starts_with(path, 'tests/')) AS n FROM files GROUP BY repo_id)
      SELECT repo_id, CASE WHEN n = 0 THEN 'Facts: the repository has no test files, so a change is checked by hand.' ELSE 'Facts: the repository has ' || n || ' test file' || CASE WHEN n = 1 THEN '.' ELSE 's.' END END AS fact FROM c""",
    "n6_revised": f"""{_WRITTEN} SELECT run_key, 's' || part AS section_id, CASE WHEN failed THEN 'failed' ELSE 'done' END AS status,
      CASE WHEN failed THEN NULL WHEN part::VARCHAR LIKE '%1' THEN 'Words of the first draft here.' ELSE 'Revised words of it here.' END AS body FROM w""",
    "n7_run_states": N7_SQL,
    "n8_named_parts": f"""{_NAMED} SELECT run_key AS conv, 's' || part AS section_id, CASE run WHEN 1 THEN 'Opening' WHEN 2 THEN 'Going on' END AS chapter_title, CASE WHEN run = 2 AND first THEN 'And then.' END AS bridge, 'part' || part AS title FROM r""",
    "n9_walkthroughs": f"""{_WRITTEN} SELECT run_key AS conv, 'Demo' AS name, 'A guided tour of Demo' AS title, 'All of it.' AS overview, 'The end of it.' AS closing, (count(*) FILTER (NOT failed))::INT AS n_parts,
      coalesce(string_agg('part' || part, ', ' ORDER BY part) FILTER (failed), '') AS missing FROM w JOIN ok USING (run_key) GROUP BY run_key""",
}
