"""Queries over text, parts in order, links, plans and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X
from corpusloom.functions import urls as U
from corpusloom.narrate import assemble as A
from corpusloom.narrate import speech as S
from corpusloom.operators import lint as L
from corpusloom.operators import links as K
from corpusloom.operators import related as RL
from corpusloom.operators import plan as PL
from corpusloom.queries.fixture import FILES_SQL, files
from corpusloom.session import read_table
from corpusloom.streaming import run_state as R


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as parts with injected sentences."""
    c = read_table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    extra = F.when(k == 0, "Keep in mind that this part probably starts below. ").when(k == 1, "The login screen stores tokens inside browser storage safely. Worth knowing, the catch is here. ").when(k == 2, "The login screen quietly stores tokens inside browser storage. Keep in mind the same rule as before applies. ").otherwise("")
    return c.select(F.col("conv_id").alias("conv"), F.col("turn").alias("part"), F.col("role").alias("chapter"), F.concat(extra, F.col("text")).alias("body"))


PARTS_SQL = """parts AS (SELECT conv_id AS conv, turn AS part, role AS chapter, (CASE (conv_id + turn) % 5 WHEN 0 THEN 'Keep in mind that this part probably starts below. '
  WHEN 1 THEN 'The login screen stores tokens inside browser storage safely. Worth knowing, the catch is here. '
  WHEN 2 THEN 'The login screen quietly stores tokens inside browser storage. Keep in mind the same rule as before applies. ' ELSE '' END) || text AS body FROM conversations)"""
SENTS_SQL = r"""sents AS (SELECT conv, part, chapter, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (
  SELECT conv, part, chapter, list_filter(list_transform(regexp_extract_all(regexp_replace(body, '\s+', ' ', 'g'), '[^.!?]+[.!?]+["”'')]*'), lambda x: trim(x)), lambda x: len(string_split(x, ' ')) >= 4) AS s FROM parts))"""
SENT_SQL = f"{PARTS_SQL},\n{SENTS_SQL}"


def _words_sql(column: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({column}), '[^a-z0-9'' ]+', ' ', 'g'), '\\s+'), lambda w: w <> '')"


_STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in X.STOP_WORDS) + "]"


def _stems_sql(column: str) -> str:
    return f"list_distinct(list_transform(list_filter({_words_sql(column)}, lambda w: NOT list_contains({_STOP}, w) AND length(w) > 2), lambda w: regexp_replace(regexp_replace(w, '''s$', ''), '(ing|ed|es|s)$', '')))"


def x8_content_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("conv", "part", F.array_join(F.array_sort(X.content_words(F.col("body"))), " ").alias("stems"), X.opening(F.col("body")).alias("opening"))


def x7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("conv", "part", F.posexplode(X.sentences(F.col("body"))).alias("pos", "sentence"))


def x9_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_flags(_parts(spark, sf_dir)).groupBy("conv", "part", "rule").agg(F.count(F.lit(1)).alias("n"))


def w2_same_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.same_openings(_parts(spark, sf_dir))


def a9_signposts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.signposts(_parts(spark, sf_dir))


def j8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.repeats(_parts(spark, sf_dir))
    return r.select("conv", "part", "pos", F.array_join(F.transform("twins", lambda x: x.cast("string")), ",").alias("twins"), "first_part", "first_pos")


def x9_back_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.back_references(_parts(spark, sf_dir)).select("conv", "part", "pos", "sentence")


J8_SQL = f"""WITH {SENT_SQL}, st AS (SELECT conv, part, pos, sentence, {_stems_sql("sentence")} AS stems FROM sents),
last AS (SELECT conv, part, lag(part) OVER (PARTITION BY conv ORDER BY part) AS prev FROM parts),
tw AS (SELECT a.conv, a.part, a.pos, b.part AS bp, b.pos AS bq FROM st a JOIN st b ON a.conv = b.conv AND b.part < a.part JOIN last l ON l.conv = a.conv AND l.part = a.part
  WHERE len(a.stems) >= 4 AND len(list_intersect(a.stems, b.stems)) >= 4
    AND len(list_intersect(a.stems, b.stems)) / greatest(1, least(len(a.stems), len(b.stems))) >= CASE WHEN b.part = l.prev THEN 0.6 ELSE 0.7 END),
g AS (SELECT conv, part, pos, string_agg(DISTINCT bp::VARCHAR, ',' ORDER BY bp::VARCHAR) AS twins, min((bp, bq)) AS m FROM tw GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv, part ORDER BY pos) AS r FROM g)
SELECT conv, part, pos::INT AS pos, twins, m[1] AS first_part, m[2]::INT AS first_pos FROM k WHERE r <= 8"""


def a12_script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.script_stats(F.col("text")).alias("s")).select("doc_id", "s.words", "s.characters", "s.minutes")


def x15_number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.number_words(F.col("doc_id") % 1000).alias("in_words"))


_ONES = "[" + ", ".join(f"'{w}'" for w in X.ONES) + "]"
_TENS = "[" + ", ".join(f"'{w}'" for w in X.TENS) + "]"
X15_SQL = f"""WITH s AS (SELECT x, CASE WHEN x < 20 THEN {_ONES}[x + 1] WHEN x % 10 = 0 THEN {_TENS}[x // 10 + 1] ELSE {_TENS}[x // 10 + 1] || '-' || {_ONES}[x % 10 + 1] END AS w FROM range(100) t(x))
SELECT doc_id, CASE WHEN doc_id % 1000 < 100 THEN s.w ELSE {_ONES}[((doc_id % 1000) // 100 + 1)::INT] || ' hundred' || CASE WHEN doc_id % 100 = 0 THEN '' ELSE ' and ' || s.w END END AS in_words
FROM documents JOIN s ON s.x = doc_id % 100"""


def x6_first_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.first_sentences(F.col("text"))).alias("first"))


X6_SQL = """WITH f AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^.!?]+[.!?]+') AS s FROM documents)
SELECT doc_id, md5(CASE WHEN len(s) > 0 THEN array_to_string(list_transform(s[1:2], lambda x: trim(x)), ' ') ELSE trim(text) END) AS first FROM f"""


def x1_strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    text = F.concat(F.lit("> see [the docs](http://x.y/z) & `code` -> done\n"), F.col("html"))
    return pages.select("page_id", F.md5(X.strip_markup(text)).alias("text_md5"))


X1_SQL = r"""WITH t AS (SELECT page_id, regexp_replace('> see [the docs](http://x.y/z) & `code` -> done' || chr(10) || html, '\r\n?', chr(10), 'g') AS t FROM pages),
a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '<!--(?s:.*?)-->', '', 'g'), '</?[a-zA-Z][^>\n]*>', '', 'g'), '(?m)^[ \t]*>[ \t]?', '', 'g') AS t FROM t),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g') AS t FROM a),
c AS (SELECT page_id, replace(t, '`', '') AS t FROM b)
SELECT page_id, md5(regexp_replace(regexp_replace(t, '[ \t]*(?:->|→|=>|⟶)[ \t]*', ' to ', 'g'), '[ \t]+&[ \t]+', ' and ', 'g')) AS text_md5 FROM c"""


def x1_speakable(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("## Setup"), k, F.lit("\n- first **item** calls `mapDispatchToProps`\n| a | b |\nSET_PAGE uses the url & json, e.g. SET_API_KEY"), k, F.lit(".\n"))
    return docs.select("doc_id", S.speakable_udf(text).alias("spoken"))


X1S_SQL = """SELECT doc_id, 'Setup' || doc_id || '.' || chr(10) || 'first item calls map dispatch to props.' || chr(10) || 'a, b.' || chr(10)
|| 'set page uses the URL and JSON, for example, set API key' || doc_id || '.' AS spoken FROM documents"""


def x5_parse_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    k = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("Sure!\n**TITLE:** Part "), k, F.lit("\nIt reads files.\nThen it sorts.\n\nSUMMARY: Reads "), k, F.lit(". CHANGES: cut one\nTERMS: Cache, *Queue*\nBUGS: none\nFACTS: - one\n- two\nBUGS: late"))
    r = docs.select("doc_id", S.parse_reply_udf(raw).alias("r"))
    return r.select("doc_id", "r.title", "r.body", "r.summary", "r.changes", F.array_join("r.terms", ",").alias("terms"), F.array_join("r.facts", ",").alias("facts"), F.array_join("r.bugs", ",").alias("bugs"))


X5_SQL = """SELECT doc_id, 'Part ' || doc_id AS title, 'It reads files. Then it sorts.' AS body, 'Reads ' || doc_id || '.' AS summary, 'cut one' AS changes, 'cache,queue' AS terms, 'one,two' AS facts, 'late' AS bugs FROM documents"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = _docs(spark, sf_dir), F.col("doc_id")
    text = F.concat(F.lit("use SET_ITEM_"), (k % 17).cast("string"), F.lit(" and getItem"), (k % 5).cast("string"), F.lit(" with 'field_"), (k % 23).cast("string"), F.lit("' or `size`\n"), F.col("text"))
    return d.select(F.col("source").alias("repo_id"), F.concat(F.lit("src/m"), k.cast("string"), F.lit(".ts")).alias("path"), F.when(k % 6 == 5, "docs").otherwise("core").alias("category"), text.alias("content"), k.alias("seq"))


NAMES_SQL = f"""code AS (SELECT source AS repo_id, 'src/m' || doc_id || '.ts' AS path, doc_id % 6 <> 5 AS is_code, 'use SET_ITEM_' || (doc_id % 17) || ' and getItem' || (doc_id % 5) || ' with ''field_' || (doc_id % 23) || ''' or `size`' || chr(10) || text AS content FROM documents),
post AS (SELECT DISTINCT repo_id, path, unnest(list_concat(
  list_filter(regexp_extract_all(content, '{K.SCREAMING}'), lambda n: length(n) >= 5),
  list_filter(regexp_extract_all(content, '{K.CAMEL}'), lambda n: length(n) >= 6 AND NOT list_contains({K.COMMON_NAMES!r}, n)),
  list_filter(regexp_extract_all(content, '["''`]([a-z][a-z0-9]*(?:_[a-z0-9]+)*)["''`]', 1), lambda n: length(n) BETWEEN 3 AND 40 AND NOT list_contains({K.COMMON_KEYS!r}, n)))) AS name FROM code WHERE is_code),
sizes AS (SELECT repo_id, count(*) AS n FROM code WHERE is_code GROUP BY ALL),
rare AS (SELECT repo_id, name, path, count(*) OVER (PARTITION BY repo_id, name) AS holders FROM post JOIN sizes USING (repo_id)
  QUALIFY count(*) OVER (PARTITION BY repo_id, name) BETWEEN 2 AND least(12, greatest(5, ceil(n * 0.03))))"""


def _rare(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _code(spark, sf_dir)
    sizes = c.filter("category = 'core'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_code"))
    return c, K.rare_names(K.postings(c), sizes)


def a4_rare_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rare(spark, sf_dir)[1].select("repo_id", "name", "path", "holders")


def j7_shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.shared_names(_rare(spark, sf_dir)[1]).select("repo_id", "path", "other", F.array_join("names", " ").alias("names"), F.round("weight", 9).alias("weight"))


def a5_link_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with reasons and names; every seventh file is a list of constants, and every third mentions what it imports."""
    c, rare = _rare(spark, sf_dir)
    k = F.col("seq")
    name = lambda n: F.concat(F.lit("m"), n.cast("string"))
    lists = F.repeat(F.lit("export const limit = 10;\n"), 12)
    c = c.withColumn("content", F.when(k % 7 == 3, lists).otherwise(F.concat(F.when(k % 3 == 0, F.concat(F.lit("call "), name(k + 20), F.lit("();\n"))).otherwise(F.lit("")), F.coalesce("content", F.lit("")))))
    edges = c.select("repo_id", F.col("path").alias("src"), F.concat(F.lit("src/"), name(k + 20), F.lit(".ts")).alias("dst")).join(c.select("repo_id", F.col("path").alias("dst")), ["repo_id", "dst"], "left_semi")
    links = RL.related_candidates(c.select("repo_id", "path", "content"), rare, edges)
    return links.select("repo_id", "path", "other", F.round("score", 6).alias("score"), F.array_join("names", " ").alias("names"), "why")


A5_SQL = f"""WITH {NAMES_SQL}, e AS (SELECT a.source AS repo_id, a.doc_id AS s, b.doc_id AS d, 'src/m' || a.doc_id || '.ts' AS src, 'src/m' || b.doc_id || '.ts' AS dst FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 20 AND a.source = b.source),
w AS (SELECT a.repo_id, a.path, b.path AS other, 4.0 / a.holders AS w, a.name, 0 AS why FROM rare a JOIN rare b ON a.repo_id = b.repo_id AND a.name = b.name AND a.path <> b.path
  UNION ALL SELECT repo_id, dst, src, 1.0, CASE WHEN d >= 10 THEN 'm' || d END, 1 FROM e UNION ALL SELECT repo_id, dst, src, 0, CASE WHEN d % 7 = 3 THEN 'limit' END, 1 FROM e
  UNION ALL SELECT repo_id, src, dst, 1.5, CASE WHEN s % 3 = 0 AND s % 7 <> 3 THEN 'm' || d END, 2 FROM e
  UNION ALL SELECT repo_id, src, dst, 0, CASE WHEN s % 7 = 3 AND d % 7 = 3 THEN 'limit' END, 2 FROM e)
SELECT repo_id, path, other, round((sum(w) * CASE WHEN regexp_extract(other, 'm(\\d+)', 1)::BIGINT % 7 = 3 THEN 0.2 ELSE 1 END)::DOUBLE, 6) AS score,
  coalesce(array_to_string(list_sort(list(DISTINCT name) FILTER (name IS NOT NULL)), ' '), '') AS names,
  array_to_string(list_transform(list_sort(list(DISTINCT why)), lambda x: ['shares names with this file', 'uses this file', 'is used by this file'][x + 1]), '; ') AS why
FROM w GROUP BY repo_id, path, other"""


def j9_best_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of eighty documents share up to four names of their own."""
    c, k = _code(spark, sf_dir), F.col("seq")
    g = F.floor(k / 80).cast("long").cast("string")
    more = F.concat(*[x for i, n in enumerate(("ONE", "TWO", "SIX", "TEN")) for x in (F.when(k % 5 == i, F.lit("")).otherwise(F.concat(F.lit(f"ROW_{n}_"), g, F.lit(" "))),)])
    c = c.withColumn("content", F.concat(more, "content"))
    sizes = c.filter("category = 'core'").groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_code"))
    return K.best_siblings(K.rare_names(K.postings(c), sizes), c.select("repo_id", "path", F.col("seq").alias("ord")))


_ROWS = " || ".join(f"CASE WHEN doc_id % 5 = {i} THEN '' ELSE 'ROW_{n}_' || (doc_id // 80) || ' ' END" for i, n in enumerate(("ONE", "TWO", "SIX", "TEN")))
J9_SQL = f"""WITH {NAMES_SQL.replace("'use SET_ITEM_'", _ROWS + " || 'use SET_ITEM_'", 1)}, o AS (SELECT source AS repo_id, 'src/m' || doc_id || '.ts' AS path, doc_id AS ord FROM documents),
n AS (SELECT repo_id, path, count(DISTINCT name) AS n FROM rare GROUP BY ALL),
p AS (SELECT a.repo_id, a.path, b.path AS sibling, ob.ord AS ord_b, count(*) AS shared FROM rare a JOIN rare b ON a.repo_id = b.repo_id AND a.name = b.name
  JOIN o oa ON oa.repo_id = a.repo_id AND oa.path = a.path JOIN o ob ON ob.repo_id = b.repo_id AND ob.path = b.path WHERE ob.ord < oa.ord GROUP BY ALL),
g AS (SELECT p.* FROM p JOIN n x ON x.repo_id = p.repo_id AND x.path = p.path JOIN n y ON y.repo_id = p.repo_id AND y.path = p.sibling WHERE shared >= 3 AND 10 * shared >= 4 * least(x.n, y.n))
SELECT repo_id, path, sibling, shared FROM g QUALIFY row_number() OVER (PARTITION BY repo_id, path ORDER BY shared DESC, ord_b) = 1"""


def x12_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each whole text that hold its first identifier of three characters or more, with two lines around."""
    f = _docs(spark, sf_dir).select(F.lit("r").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).alias("content"))
    first = F.regexp_extract("content", r"[A-Za-z0-9_$]{3,}", 0)
    return K.excerpts(f, f.select("repo_id", "path", F.lit("k").alias("key"), F.array(first).alias("names"))).select("path", F.md5("excerpt").alias("excerpt_md5"))


X12_SQL = r"""WITH d AS (SELECT doc_id::VARCHAR AS path, string_split(coalesce(text, ''), chr(10)) AS l, regexp_extract(coalesce(text, ''), '[A-Za-z0-9_$]{3,}') AS name FROM documents),
x AS (SELECT path, name, unnest(range(len(l))) AS i, unnest(l) AS t FROM d),
v AS (SELECT *, regexp_matches(t, '^\s*(import\b|from\s+\S+\s+import\b|export\s+\{[^}]*\}\s+from\b|export\s+\*\s+from\b|(const|let|var)\s+[\w{}\s,]+=\s*require\()') AS imports FROM x),
h AS (SELECT path, i FROM v WHERE NOT imports AND length(t) <= 400 AND list_contains(regexp_extract_all(t, '[A-Za-z0-9_$]+'), name)),
n AS (SELECT DISTINCT path, unnest([i - 2, i - 1, i, i + 1, i + 2]) AS i FROM h),
p AS (SELECT v.path, v.i, CASE WHEN v.i > lag(v.i) OVER o + 1 THEN '…' || chr(10) ELSE '' END || v.t AS piece FROM n JOIN v ON v.path = n.path AND v.i = n.i WHERE NOT imports WINDOW o AS (PARTITION BY v.path ORDER BY v.i)),
c AS (SELECT *, sum(length(piece) + 1) OVER (PARTITION BY path ORDER BY i) <= 1200 AS fits FROM p),
e AS (SELECT path, coalesce(string_agg(piece, chr(10) ORDER BY i) FILTER (fits) || CASE WHEN bool_and(fits) THEN '' ELSE chr(10) || '…' END, '…') AS t FROM c GROUP BY path)
SELECT d.path, md5(trim(coalesce(e.t, ''), ' ')) AS excerpt_md5 FROM d LEFT JOIN e ON e.path = d.path"""


def _told(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts that end by explaining the first word, or the first two words, of their text, and the terms of each conversation."""
    p = _parts(spark, sf_dir)
    one = F.lower(F.regexp_extract("body", r"[A-Za-z]{3,}", 0))
    term = F.when(F.col("part") % 2 == 0, one).otherwise(F.concat(one, F.lit(" Table")))
    said = p.select("conv", "part", F.concat("body", F.lit(" We meet the "), term, F.when(F.col("part") % 3 == 0, F.lit("s")).otherwise(F.lit("")), F.lit(", which does it.")).alias("body"), term.alias("term"))
    return said.select("conv", "part", "body"), said.filter("part % 5 <> 1 AND term <> ''").select("conv", F.lower("term").alias("term")).distinct()


def x9_terms_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, terms = _told(spark, sf_dir)
    return L.terms_explained_again(parts, terms)


X9_TERMS_SQL = f"""WITH {PARTS_SQL.replace("parts AS", "raw_parts AS", 1)},
said AS (SELECT *, CASE WHEN part % 2 = 0 THEN w ELSE w || ' Table' END AS term FROM (SELECT conv, part, chapter, body AS b, lower(regexp_extract(body, '[A-Za-z]{{3,}}')) AS w FROM raw_parts)),
parts AS (SELECT conv, part, chapter, b || ' We meet the ' || term || CASE WHEN part % 3 = 0 THEN 's' ELSE '' END || ', which does it.' AS body FROM said),
terms AS (SELECT DISTINCT conv, lower(term) AS term FROM said WHERE part % 5 <> 1 AND term <> ''),
{SENTS_SQL}
SELECT s.conv, s.part, t.term, arg_min(s.sentence, s.pos) AS sentence FROM sents s JOIN terms t ON t.conv = s.conv
WHERE regexp_matches(s.sentence, '(?i)\\b(?:a|an|the) ' || regexp_escape(t.term) || 's?, (?:the|a|an|which|meaning) ') GROUP BY s.conv, s.part, t.term"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions import paths as P

    f = files(spark, sf_dir)
    return f.select("repo_id", "seq", "path", P.category(F.col("path")).alias("category"), (F.col("seq") % 97).cast("int").alias("importance"), (F.col("seq") % 13 * 20).cast("int").alias("lines"), (F.col("seq") % 40 == 9).alias("is_entry"), F.lit(False).alias("is_markup"))


def _plan_sql() -> str:
    from corpusloom.queries.ingest import CATEGORY_CASE
    from corpusloom.queries.ingest import PARTS_SQL as FILE_PARTS

    return f"""{FILES_SQL}, {FILE_PARTS}, planned AS (SELECT repo_id, seq, path, {CATEGORY_CASE} AS category, seq % 97 AS importance, seq % 13 * 20 AS lines, seq % 40 = 9 AS is_entry FROM parts),
groups0 AS (SELECT *, CASE category WHEN 'config' THEN 'config' WHEN 'test' THEN 'tests' WHEN 'docs' THEN 'docs'
  WHEN 'data' THEN CASE WHEN regexp_matches(path, '(^|/)(migrations?|seeds?|seeders)/') THEN 'migrations' ELSE 'data' END WHEN 'style' THEN 'styles' WHEN 'script' THEN 'scripts'
  WHEN 'component' THEN CASE WHEN regexp_matches(path, '(^|/)components/ui/') OR regexp_matches(path, '(^|/)ui/primitives/') THEN 'ui-kit' END END AS g,
  bool_or(category NOT IN ('config', 'docs', 'data', 'test', 'style')) OVER (PARTITION BY repo_id) AS code FROM planned),
groups AS (SELECT *, CASE WHEN NOT code THEN NULL WHEN g = 'ui-kit' AND count(*) FILTER (g = 'ui-kit') OVER (PARTITION BY repo_id) <= 3 THEN NULL ELSE g END AS group_kind FROM groups0)"""


def l1_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.split_groups(_planned(spark, sf_dir)).select("seq", F.coalesce("group_kind", F.lit("-")).alias("group_kind"))


def t4_topk_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.split_overflow(PL.split_groups(_planned(spark, sf_dir)), 14).select("seq", "is_overflow")


def t5_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.depths(_planned(spark, sf_dir), 6, 2).select("seq", "depth")


T5_SQL = """, may AS (SELECT *, is_entry OR (lines >= CASE WHEN category = 'route' THEN 30 ELSE 50 END AND category NOT IN ('style', 'script', 'data')) AS may FROM planned),
r AS (SELECT *, may AND row_number() OVER (PARTITION BY repo_id, may ORDER BY importance DESC, seq) <= 6 AS f FROM may),
m AS (SELECT *, row_number() OVER (PARTITION BY repo_id, f AND lines >= 180 ORDER BY importance DESC, seq) AS n FROM r)
SELECT seq, CASE WHEN f AND lines >= 180 AND n <= 2 THEN 'major' WHEN f THEN 'full' ELSE 'brief' END AS depth FROM m"""


def l6_cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _planned(spark, sf_dir).withColumn("tier", PL.tier_of(F.col("category")))
    return PL.cluster_order(f, [F.desc("importance"), F.col("path"), F.col("seq")]).select("repo_id", "seq", "tier", "ord", "cluster")


L6_SQL = """, t AS (SELECT *, CASE category WHEN 'route' THEN 1 WHEN 'core' THEN 2 WHEN 'component' THEN 3 WHEN 'helper' THEN 4 WHEN 'script' THEN 5 WHEN 'style' THEN 6 WHEN 'data' THEN 7 WHEN 'config' THEN 8 WHEN 'test' THEN 9 WHEN 'docs' THEN 10 END AS tier,
  array_to_string(string_split(CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END, '/')[1:2], '/') AS cluster FROM planned),
i AS (SELECT *, row_number() OVER (PARTITION BY repo_id, tier, cluster ORDER BY importance DESC, path, seq) AS k, max(importance) OVER (PARTITION BY repo_id, tier, cluster) AS top FROM t),
l AS (SELECT *, first_value(path) OVER (PARTITION BY repo_id, tier, cluster ORDER BY k) AS lead FROM i)
SELECT repo_id, seq, tier::INT AS tier, (row_number() OVER (PARTITION BY repo_id, tier ORDER BY top DESC, lead, k))::INT AS ord, cluster FROM l"""


def l7_fold_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _planned(spark, sf_dir).groupBy("repo_id", "path", "category").agg(F.min("seq").alias("seq"))
    f = f.withColumn("tier", PL.tier_of(F.col("category")).cast("int")).withColumn("ord", F.col("seq").cast("int")).withColumn("depth", F.when(F.col("seq") % 3 == 0, "full").otherwise("brief"))
    return PL.fold_folders(f).select("repo_id", "tier", "ord", "section_id", "kind", F.size("paths").alias("n"))


L7_SQL = """, u AS (SELECT repo_id, path, category, min(seq) AS seq FROM planned GROUP BY ALL),
t AS (SELECT *, CASE category WHEN 'entry' THEN 0 WHEN 'route' THEN 1 WHEN 'core' THEN 2 WHEN 'component' THEN 3 WHEN 'helper' THEN 4 WHEN 'script' THEN 5 WHEN 'style' THEN 6 WHEN 'data' THEN 7 WHEN 'config' THEN 8 WHEN 'test' THEN 9 WHEN 'docs' THEN 10 END AS tier,
  CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, seq % 3 <> 0 AS brief FROM u),
b AS (SELECT *, brief AND count(*) FILTER (brief) OVER (PARTITION BY repo_id, tier, dir) >= 3 AS fold FROM t)
SELECT repo_id, tier::INT AS tier, min(seq)::INT AS ord, CASE WHEN fold THEN 'group:folder:' || tier || ':' || dir ELSE 'file:' || path END AS section_id, CASE WHEN fold THEN 'group' ELSE 'file' END AS kind, count(*)::INT AS n
FROM b GROUP BY repo_id, tier, fold, CASE WHEN fold THEN 'group:folder:' || tier || ':' || dir ELSE 'file:' || path END"""


def l13_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = PL.chunked(_docs(spark, sf_dir).select("doc_id", F.col("text").alias("content")), 1500)
    joined = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk.index", "chunk.text"))).alias("p"), F.max("chunk.total").alias("n"), F.max("chunk.end_line").alias("lines"))
    return joined.select("doc_id", F.md5(F.array_join("p.text", "\n")).alias("text_md5"), (F.col("n") == F.size("p")).alias("counted"), "lines")


L13_SQL = "SELECT doc_id, md5(text) AS text_md5, true AS counted, len(string_split(text, chr(10)))::INT AS lines FROM documents"


def p10_word_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (F.col("doc_id") % 150).cast("int")
    return _docs(spark, sf_dir).select("doc_id", PL.word_target(F.lit(120), F.lit(300), lines).alias("t"), PL.size_label(lines).alias("label")).select("doc_id", "t.lo", "t.hi", "label")


P10_SQL = """WITH t AS (SELECT doc_id, doc_id % 150 AS n, CASE WHEN doc_id % 150 < 40 THEN 0.65::DOUBLE WHEN doc_id % 150 < 100 THEN 0.85::DOUBLE ELSE 1 END AS f FROM documents)
SELECT doc_id, greatest(50, floor(120 * f / 10 + 0.5) * 10)::INT AS lo, greatest(90, floor(300 * f / 10 + 0.5) * 10)::INT AS hi, CASE WHEN n < 30 THEN 'very short' ELSE 'short' END AS label FROM t"""


def a6_tree_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return PL.tree_counts(f.filter("seq % 4 <> 0"), f.filter("seq % 4 = 0").select("repo_id", "path", (F.col("seq") % 8 == 0).alias("is_dir")))


A6_SQL = f"""WITH {FILES_SQL}, s AS (SELECT repo_id, seq, path, string_split(path, '/') AS segs FROM files),
x AS (SELECT repo_id, array_to_string(segs[1:unnest(range(len(segs)))], '/') AS dir, seq % 4 = 0 AS gone FROM s
  UNION ALL SELECT repo_id, path, true FROM s WHERE seq % 8 = 0)
SELECT repo_id, dir, count(*) FILTER (NOT gone) AS included, count(*) FILTER (gone) AS skipped FROM x GROUP BY ALL"""


def w1_dedupe_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("repo_id"), F.col("turn").alias("ord"), F.col("role").alias("section_id"))
    return PL.unique_ids(c)


def w6_lag_lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.neighbours(_parts(spark, sf_dir).select("conv", F.col("part").alias("ord"), F.concat("chapter", F.col("part").cast("string")).alias("label")))


def w7_chapter_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.chapter_runs(_parts(spark, sf_dir).select("conv", F.col("part").alias("ord"), F.when(F.col("part") < 3, "a").otherwise(F.col("chapter")).alias("chapter")))


def w9_disambiguate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select(F.col("source").alias("conv"), "doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "Item").otherwise("item"), (F.col("doc_id") % 31).cast("string")).alias("name"), F.concat(F.lit("f"), (F.col("doc_id") % 3).cast("string")).alias("folder"))
    return A.disambiguate(n).select("doc_id", "spoken")


def n10_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir).select("conv", F.col("part").alias("ord"), F.col("chapter"), F.concat(F.lit("About "), "chapter").alias("chapter_title"), F.lit("").alias("bridge"), F.concat(F.lit("Turn "), F.col("part").cast("string")).alias("title"), "body")
    tours = p.select("conv").distinct().select("conv", F.lit("demo").alias("name"), F.lit("The overview.").alias("overview"), F.lit("The end.").alias("closing"))
    return A.listening_script(p, tours)


N10_SQL = f"""WITH {PARTS_SQL}, f AS (SELECT conv, part, chapter, body, lag(chapter) OVER w IS NULL OR lag(chapter) OVER w <> chapter AS fst, row_number() OVER w AS num FROM parts WINDOW w AS (PARTITION BY conv ORDER BY part)),
r AS (SELECT *, sum(fst::INT) OVER (PARTITION BY conv ORDER BY part) AS run FROM f), z AS (SELECT *, count(*) OVER (PARTITION BY conv, run) AS k FROM r),
w AS (SELECT *, {_ONES} AS ones FROM z),
b AS (SELECT conv, string_agg(CASE WHEN fst THEN 'Chapter ' || ones[(run + 1)::INT] || '. About ' || chapter || '.' || chr(10) || chr(10) ELSE '' END || CASE WHEN k > 1 THEN 'Part ' || ones[(num + 1)::INT] || '. Turn ' || part || '.' || chr(10) || chr(10) ELSE '' END || trim(body), chr(10) || chr(10) ORDER BY part) AS t FROM w GROUP BY conv)
SELECT conv, 'A guided tour of demo.' || chr(10) || chr(10) || 'The overview.' || chr(10) || chr(10) || t || chr(10) || chr(10) || '{A.LAST_STOP}' || chr(10) || chr(10) || 'The end.' || chr(10) AS script FROM b"""


def a15_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _parts(spark, sf_dir).select("conv", "part", F.posexplode(X.sentences(F.col("body"))).alias("ord", "line"))
    return A.ledger_lines(n)


A15_SQL = f"""WITH {SENT_SQL}, k AS (SELECT conv, part, pos, sentence AS line, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS key FROM sents)
SELECT conv, key, arg_min(part, (part, pos, line)) AS part, arg_min(line, (part, pos, line)) AS line FROM k WHERE key <> '' GROUP BY conv, key"""


def w5_terms_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each body."""
    return A.terms_seen(_parts(spark, sf_dir).select("conv", "part", F.explode(X.words(F.col("body"))).alias("term")))


W5_SQL = f"""WITH {PARTS_SQL}, t AS (SELECT conv, part, unnest({_words_sql("body")}) AS term FROM parts),
f AS (SELECT conv, term, min(part) AS part FROM t GROUP BY ALL)
SELECT p.conv, p.part, least(40, (SELECT count(*) FROM f WHERE f.conv = p.conv AND f.part < p.part))::BIGINT AS known FROM (SELECT DISTINCT conv, part FROM t) p"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 50).alias("run_id"), F.col("user_id").alias("section_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "ts")


def n12_run_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_states(_events(spark, sf_dir))


def w10_failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("run_id", "seq", (F.col("seq") % 5 < 2).alias("ok"))
    return A.failure_runs(e)


W10_SQL = """WITH e AS (SELECT user_id % 50 AS run_id, event_id AS seq, event_id % 5 < 2 AS ok FROM events), s AS (SELECT *, sum(ok::INT) OVER (PARTITION BY run_id ORDER BY seq) AS k FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY run_id, k ORDER BY seq) AS n FROM s WHERE NOT ok) SELECT run_id, seq FROM f WHERE n = 3"""


def s1_repo_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    k = F.col("page_id")
    raw = F.when(k % 6 == 0, F.concat(F.lit("git@github.com:own-er/repo"), k.cast("string"), F.lit(".git"))).when(k % 6 == 1, F.concat(F.lit("owner/repo"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("  https://www.github.com/owner/repo/tree/main/src/x"), k.cast("string"), F.lit("?tab=1#top"))).when(k % 6 == 3, F.lit("github.com/settings/profile")).when(k % 6 == 4, F.lit("https://github.com/o/r/blob/dev/a%20b/c.ts")).otherwise(F.col("url"))
    t = pages.select("page_id", U.repo_target(raw).alias("t"))
    return t.select("page_id", "t.owner", "t.repo", F.array_join("t.tree_segments", "|").alias("tree"), "t.points_at_file", "t.error")


S1_SQL = """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'own-er' WHEN 1 THEN 'owner' WHEN 2 THEN 'owner' WHEN 4 THEN 'o' END AS owner,
CASE page_id % 6 WHEN 0 THEN 'repo' || page_id WHEN 1 THEN 'repo' || page_id WHEN 2 THEN 'repo' WHEN 4 THEN 'r' END AS repo,
CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'main|src|x' || page_id WHEN 4 THEN 'dev|a b|c.ts' END AS tree, page_id % 6 = 4 AS points_at_file,
CASE page_id % 6 WHEN 3 THEN 'owner' WHEN 5 THEN 'host' END AS error FROM pages"""


def s2_ref_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    tree = F.slice(F.array(F.lit("feature"), F.lit("login"), F.lit("src"), F.lit("a"), F.lit("b.ts")), F.lit(1), (F.col("page_id") % 6).cast("int"))
    c = pages.select("page_id", F.posexplode(U.ref_candidates(tree, F.col("page_id") % 2 == 1)).alias("rank", "c"))
    return c.select("page_id", "rank", "c.ref", "c.subpath")


S2_SQL = """WITH t AS (SELECT page_id, ['feature', 'login', 'src', 'a', 'b.ts'][1:page_id % 6] AS t, page_id % 2 = 1 AS f FROM pages),
x AS (SELECT page_id, t, f, unnest(range(1, least(len(t), 4) + 1)) AS i FROM t WHERE len(t) > 0)
SELECT page_id, (i - 1)::INT AS rank, array_to_string(t[1:i], '/') AS ref, array_to_string(t[i + 1:len(t) - CASE WHEN f THEN 1 ELSE 0 END], '/') AS subpath FROM x
UNION ALL SELECT page_id, 0, 'HEAD', '' FROM t WHERE len(t) = 0"""


def f18_private_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    ip = F.concat_ws(".", (k * 7 % 256).cast("string"), (k * 13 % 256).cast("string"), F.lit("1"), F.lit("2"))
    six = F.when(k % 3 == 0, F.concat(F.lit("::ffff:"), ip)).when(k % 3 == 1, F.lit("fe80::1")).otherwise(F.lit("2606:4700::1"))
    return _docs(spark, sf_dir).select("doc_id", U.is_private_ipv4(ip).alias("v4"), U.is_private_address_udf(six).alias("v6"))


F18_SQL = """WITH b AS (SELECT doc_id, doc_id * 7 % 256 AS a, doc_id * 13 % 256 AS b FROM documents),
p AS (SELECT doc_id, a IN (0, 10, 127) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b IN (0, 168)) OR (a = 198 AND b IN (18, 19)) OR a >= 224 AS v4 FROM b)
SELECT doc_id, v4, CASE doc_id % 3 WHEN 0 THEN v4 WHEN 1 THEN true ELSE false END AS v6 FROM p"""


def p14_error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.element_at(F.lit([400, 401, 402, 403, 404, 408, 429, 500]), (k % 8 + 1).cast("int"))
    text = F.element_at(F.lit(["", "maximum context length", "Rate limit reached", "model x does not exist", "billing hard limit"]), (k % 5 + 1).cast("int"))
    kind = U.error_kind(status, text)
    return _docs(spark, sf_dir).select("doc_id", kind.alias("kind"), U.is_retryable(kind).alias("retryable"))


P14_SQL = """WITH t AS (SELECT doc_id, [400, 401, 402, 403, 404, 408, 429, 500][(doc_id % 8 + 1)::INT] AS s, doc_id % 5 AS m FROM documents),
k AS (SELECT doc_id, CASE WHEN m = 1 AND s <> 429 THEN 'context' WHEN s = 401 THEN 'auth' WHEN s = 402 OR m = 4 THEN 'credits' WHEN s = 404 OR m = 3 THEN 'model' WHEN s = 429 OR m = 2 THEN 'rate_limit'
  WHEN s = 403 THEN 'auth' WHEN s IN (408, 500) THEN 'server' ELSE 'bad_request' END AS kind FROM t)
SELECT doc_id, kind, kind IN ('rate_limit', 'server', 'network', 'empty') AS retryable FROM k"""


def x18_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return _docs(spark, sf_dir).select("doc_id", U.backoff_ms(F.when(k % 2 == 0, "rate_limit").otherwise("server"), k % 7, (k % 10) / 10.0).cast("long").alias("wait_ms"), U.retry_after_ms(F.when(k % 3 == 0, F.lit("soon")).otherwise((k % 300).cast("string"))).alias("after_ms"))


X18_SQL = """SELECT doc_id, floor(least(60000.0, CASE WHEN doc_id % 2 = 0 THEN 4000.0 ELSE 1500.0 END * pow(2.0, doc_id % 7))::DOUBLE * (0.75::DOUBLE + ((doc_id % 10) / 10.0)::DOUBLE * 0.5::DOUBLE))::BIGINT AS wait_ms,
CASE WHEN doc_id % 3 = 0 THEN NULL ELSE least(120000, (doc_id % 300) * 1000) END::BIGINT AS after_ms FROM documents"""


def f12_trivial(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.lit("// only\n# notes\n")).when(k % 4 == 1, F.lit("import a\nexport * from './b'\n__all__ = 1\nfrom x import y\n")).when(k % 4 == 2, F.concat(F.lit("import a\nimport b\nx = "), k.cast("string"), F.lit(" + 1;\n"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", PL.is_trivial(text).alias("trivial"), K.is_registry(F.concat(F.repeat(F.lit("export const A = 'a';\n"), 9), F.repeat(F.lit("call(x)\n"), (k % 9).cast("int")))).alias("registry"))


F12_SQL = """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#|/\\*|\\*|\"\"\"|'''''')')) AS l FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE len(l) <= 2 OR (len(l) <= 20 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\\w.]+,?$'))) = 0) END AS trivial,
9 / (9 + doc_id % 9) > 0.6 AS registry FROM l"""


def t10_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _docs(spark, sf_dir).select(F.col("source").alias("repo_id"), "doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "File").otherwise("file"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("name"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("repo_id").orderBy(PL.natural_key(F.col("name"))))).select("doc_id", "rank")


QUERIES = {
    "x7_sentences": x7_sentences, "x8_content_words": x8_content_words, "x9_rule_flags": x9_rule_flags, "x9_back_references": x9_back_references, "x9_terms_again": x9_terms_again,
    "w2_same_opening": w2_same_opening, "a9_signposts": a9_signposts, "j8_repeats": j8_repeats, "a12_script_stats": a12_script_stats,
    "x15_number_words": x15_number_words, "x6_first_sentences": x6_first_sentences, "x1_strip_markup": x1_strip_markup, "x1_speakable": x1_speakable,
    "x5_parse_reply": x5_parse_reply, "a4_rare_names": a4_rare_names, "j7_shared_names": j7_shared_names, "a5_link_score": a5_link_score,
    "j9_best_siblings": j9_best_siblings, "x12_excerpt": x12_excerpt, "l1_group_split": l1_group_split, "t4_topk_overflow": t4_topk_overflow,
    "t5_depth": t5_depth, "l6_cluster_order": l6_cluster_order, "l7_fold_folders": l7_fold_folders, "l13_chunks": l13_chunks,
    "p10_word_targets": p10_word_targets, "a6_tree_rollup": a6_tree_rollup, "w1_dedupe_ids": w1_dedupe_ids, "w6_lag_lead": w6_lag_lead,
    "w7_chapter_runs": w7_chapter_runs, "w9_disambiguate": w9_disambiguate, "n10_script": n10_script, "a15_ledger": a15_ledger,
    "w5_terms_seen": w5_terms_seen, "n12_run_state": n12_run_state, "w10_failure_runs": w10_failure_runs, "s1_repo_url": s1_repo_url,
    "s2_ref_candidates": s2_ref_candidates, "f18_private_ip": f18_private_ip, "p14_error_class": p14_error_class, "x18_backoff": x18_backoff,
    "f12_trivial": f12_trivial, "t10_natural_order": t10_natural_order,
}
_RULE_CASES = " UNION ALL ".join(f"SELECT conv, part, '{n}' AS rule FROM sents WHERE {{}}".format(f"regexp_matches(sentence, '{p.replace(chr(39), chr(39) * 2)}')") for n, p in L.RULES.items() if n != "spoken_dot")
ORACLES = {
    "x7_sentences": f"WITH {SENT_SQL} SELECT conv, part, pos::INT AS pos, sentence FROM sents",
    "x8_content_words": f"WITH {PARTS_SQL} SELECT conv, part, array_to_string(list_sort({_stems_sql('body')}), ' ') AS stems, array_to_string({_words_sql('body')}[1:3], ' ') AS opening FROM parts",
    "x9_rule_flags": f"WITH {SENT_SQL} SELECT conv, part, rule, count(*) AS n FROM ({_RULE_CASES}) GROUP BY ALL",
    "x9_back_references": f"""WITH {SENT_SQL}, st AS (SELECT conv, part, pos, sentence, {_stems_sql('sentence')} AS s FROM sents) SELECT conv, part, pos::INT AS pos, sentence FROM st a WHERE regexp_matches(sentence, '{L.BACK_REFERENCE}')
      AND NOT EXISTS (SELECT 1 FROM st b WHERE b.conv = a.conv AND b.part < a.part AND len(list_intersect(a.s, b.s)) >= 3)""",
    "w2_same_opening": f"""WITH {PARTS_SQL}, o AS (SELECT conv, part, array_to_string({_words_sql('body')}[1:3], ' ') AS opening, row_number() OVER (PARTITION BY conv ORDER BY part) AS k FROM parts)
      SELECT a.conv, a.part, a.opening, min(b.part) AS same_as FROM o a JOIN o b ON a.conv = b.conv AND b.k BETWEEN a.k - 4 AND a.k - 1 AND a.opening = b.opening WHERE a.opening <> '' GROUP BY ALL""",
    "a9_signposts": f"""WITH {PARTS_SQL}, e AS (SELECT conv, part, lower(unnest(regexp_extract_all(body, '{L.SIGNPOSTS.replace(chr(39), chr(39) * 2)}'))) AS phrase FROM parts), c AS (SELECT conv, part, phrase, count(*) AS n FROM e GROUP BY ALL),
      u AS (SELECT conv, part, phrase, coalesce(sum(n) OVER (PARTITION BY conv, phrase ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used FROM c) SELECT * FROM u WHERE used >= 2""",
    "j8_repeats": J8_SQL,
    "a12_script_stats": "SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))::INT AS words, length(text)::INT AS characters, greatest(1, floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) / 150.0 + 0.5))::INT AS minutes FROM documents",
    "x15_number_words": X15_SQL, "x6_first_sentences": X6_SQL, "x1_strip_markup": X1_SQL, "x1_speakable": X1S_SQL, "x5_parse_reply": X5_SQL,
    "a4_rare_names": f"WITH {NAMES_SQL} SELECT repo_id, name, path, holders FROM rare",
    "j7_shared_names": f"WITH {NAMES_SQL} SELECT a.repo_id, a.path, b.path AS other, string_agg(a.name, ' ' ORDER BY a.name) AS names, round(sum(4.0 / a.holders)::DOUBLE, 9) AS weight FROM rare a JOIN rare b ON a.repo_id = b.repo_id AND a.name = b.name AND a.path <> b.path GROUP BY ALL",
    "a5_link_score": A5_SQL, "j9_best_siblings": J9_SQL, "x12_excerpt": X12_SQL, "x9_terms_again": X9_TERMS_SQL,
    "l1_group_split": f"WITH {_plan_sql()} SELECT seq, coalesce(group_kind, '-') AS group_kind FROM groups",
    "t4_topk_overflow": f"WITH {_plan_sql()}, n AS (SELECT repo_id, count(DISTINCT group_kind) AS k FROM groups GROUP BY ALL) SELECT seq, group_kind IS NULL AND row_number() OVER (PARTITION BY g.repo_id, group_kind IS NULL ORDER BY importance DESC, seq) > greatest(8, 14 - n.k) AS is_overflow FROM groups g JOIN n USING (repo_id)",
    "t5_depth": f"WITH {_plan_sql()}{T5_SQL}", "l7_fold_folders": f"WITH {_plan_sql()}{L7_SQL}", "l6_cluster_order": f"WITH {_plan_sql()}{L6_SQL}", "l13_chunks": L13_SQL, "p10_word_targets": P10_SQL,
    "a6_tree_rollup": A6_SQL,
    "w1_dedupe_ids": "SELECT repo_id, ord, CASE WHEN n > 1 THEN section_id || '#' || n ELSE section_id END AS section_id FROM (SELECT conv_id AS repo_id, turn AS ord, role AS section_id, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)",
    "w6_lag_lead": f"WITH {PARTS_SQL} SELECT conv, part AS ord, lag(chapter || part) OVER w AS before, lead(chapter || part) OVER w AS next_one, lead(chapter || part, 2) OVER w AS next_two FROM parts WINDOW w AS (PARTITION BY conv ORDER BY part)",
    "w7_chapter_runs": f"""WITH {PARTS_SQL}, c AS (SELECT conv, part AS ord, CASE WHEN part < 3 THEN 'a' ELSE chapter END AS chapter FROM parts), f AS (SELECT *, lag(chapter) OVER w IS DISTINCT FROM chapter OR lag(ord) OVER w IS NULL AS first_of_run FROM c WINDOW w AS (PARTITION BY conv ORDER BY ord)),
      r AS (SELECT *, sum(first_of_run::INT) OVER (PARTITION BY conv ORDER BY ord)::INT AS run FROM f) SELECT *, count(*) OVER (PARTITION BY conv, run) AS run_size FROM r""",
    "w9_disambiguate": "WITH n AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'Item' ELSE 'item' END || (doc_id % 31) AS name, 'f' || (doc_id % 3) AS folder FROM documents) SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY source, lower(name)) > 1 THEN name || ', in the ' || folder || ' folder' ELSE name END AS spoken FROM n",
    "n10_script": N10_SQL, "a15_ledger": A15_SQL, "w5_terms_seen": W5_SQL,
    "n12_run_state": "SELECT user_id % 50 AS run_id, user_id AS section_id, arg_max(event_type, (event_id, event_type)) AS status, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY ALL",
    "w10_failure_runs": W10_SQL, "s1_repo_url": S1_SQL, "s2_ref_candidates": S2_SQL, "f18_private_ip": F18_SQL, "p14_error_class": P14_SQL,
    "x18_backoff": X18_SQL, "f12_trivial": F12_SQL,
    "t10_natural_order": "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INT AS rank FROM documents",
}
