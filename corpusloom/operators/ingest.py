"""Turning archive entries into a table of files worth reading: content filters, limits, ignore rules, trimming, statistics.

Tables have repo_id and, for arrival order, seq. Everything is per repository and runs for all of them at once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions import constants as C
from corpusloom.functions import paths as P
from corpusloom.operators.rule_trie import RuleTrie, character_set

#: Characters that count as blank, in any script.
BLANK = r"[\s\u000B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def is_blank(text: Column) -> Column:
    """nothing but white space."""
    return ~text.rlike(rf"[^{BLANK[1:-1]}]")


def decode_text(data: Column) -> Column:
    """bytes as text with one kind of line end, or null where they look binary.

    Binary: a zero byte within 8000 bytes, or more than 8 bad sequences that are over 1 % of the characters."""
    raw = F.make_valid_utf8(data.cast("string"))
    bad = F.length(raw) - F.length(F.replace(raw, F.lit("\ufffd"), F.lit("")))
    binary = (F.locate("\x00", F.make_valid_utf8(F.substring(data, 1, 8000).cast("string"))) > 0) | ((bad > 8) & (bad / F.greatest(F.length(raw), F.lit(1)) > 0.01))
    plain = F.regexp_replace(F.regexp_replace(raw, "\\A\ufeff", ""), "\r\n?", "\n")
    return F.when(~binary, plain)


def looks_generated(path: Column, text: Column) -> Column:
    """a banner in the first six lines of a file that is not prose, or very long lines almost throughout."""
    lines = F.split(text, "\n", -1)
    head = F.array_join(F.slice(lines, 1, 6), "\n")
    longest = F.array_max(F.transform(lines, lambda x: F.length(x)))
    minified = (F.length(text) > 4000) & (longest > 2000) & (F.length(text) / F.size(lines) > 400)
    return (head.rlike(C.GENERATED_BANNER) & ~path.rlike(C.PROSE_FILE)) | minified


CELLS = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([T.StructField("cell_type", T.StringType()), T.StructField("source", T.StringType())])))])


def notebook_text(raw: Column) -> Column:
    """The sources of a notebook's cells under numbered headings, notes as comments; null if it is no notebook."""
    cells = F.from_json(raw, CELLS)["cells"]

    def source(cell: Column) -> Column:
        listed = F.from_json(cell["source"], "array<string>")
        return F.when(F.startswith(cell["source"], F.lit("[")) & listed.isNotNull(), F.array_join(listed, "")).otherwise(F.coalesce(cell["source"], F.lit("")))

    def shown(cell: Column, i: Column) -> Column:
        text, number = source(cell), (i + 1).cast("string")
        notes = F.concat(F.lit("# --- Cell "), number, F.lit(" (notes) ---\n# "), F.replace(text, F.lit("\n"), F.lit("\n# ")))
        code = F.concat(F.lit("# --- Cell "), number, F.lit(" (code) ---\n"), text)
        return F.when(is_blank(text) | (text == ""), F.lit("")).when(cell["cell_type"] == "markdown", notes).otherwise(code)

    return F.array_join(F.filter(F.transform(cells, shown), lambda x: x != ""), "\n\n")


def skipped_paths(files: DataFrame) -> DataFrame:
    """(repo_id, path, reason, is_dir) for files (repo_id, path, size) that their path rules out; a folder once."""
    judged = files.withColumn("verdict", P.path_verdict(F.col("path"), F.col("size"))).filter("verdict.reason IS NOT NULL")
    at = F.col("verdict.dir_depth")
    folder = F.array_join(F.slice(P.segments(F.col("path")), F.lit(1), at + 1), "/")
    out = judged.select("repo_id", F.when(at.isNotNull(), folder).otherwise(F.col("path")).alias("path"), F.col("verdict.reason").alias("reason"), at.isNotNull().alias("is_dir"))
    return out.filter("is_dir").dropDuplicates(["repo_id", "path"]).unionByName(out.filter("NOT is_dir"))


def arrival_limit(files: DataFrame, max_files: int = C.MAX_FILES, max_bytes: int = 3 * C.MAX_TOTAL_BYTES) -> DataFrame:
    """adds over_limit: files that arrive after enough files, or after more than enough bytes, were kept.

    files: repo_id, seq, bytes, passes (whether the content filters keep it)."""
    before = Window.partitionBy("repo_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.coalesce(F.sum(F.col("passes").cast("int")).over(before), F.lit(0))
    size = F.coalesce(F.sum(F.when(F.col("passes"), F.col("bytes"))).over(before), F.lit(0))
    return files.withColumn("over_limit", (kept >= max_files) | (size > max_bytes))


# --- ignore rules ---------------------------------------------------------------------------------------------


def rule_regex(pattern: str) -> tuple[str, bool] | None:
    """F8: an ignore pattern as (regular expression for a relative path, whether it un-ignores); null for no rule."""
    line = pattern.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    if line.startswith(("\\#", "\\!")):
        line = line[1:]
    folder_only = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out += "/.+"
            i += 3
        elif c == "*":
            while i < len(line) and line[i] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
            i += 1
        elif c == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out += character_set(line[i + 1 : end])
            i = end + 1
        elif c == "\\" and i + 1 < len(line):
            out += _quoted(line[i + 1])
            i += 2
        else:
            out += _quoted(c)
            i += 1
    head = "^" if anchored else "(?:^|.*/)"
    tail = "/.+$" if folder_only else "(?:$|/.*$)"
    return head + out + tail, negated


def _quoted(c: str) -> str:
    return "\\" + c if c in "\\.^$|()[]{}*+?" else c


def parse_rules(rule_files: DataFrame) -> DataFrame:
    """Rule files (repo_id, seq, path, size, content) as (repo_id, scope, depth, ord, regex, negated), within budget.

    Rule files are configuration of bounded size; each is parsed whole by one call."""
    order = Window.partitionBy("repo_id").orderBy("seq")
    files = rule_files.filter(F.col("size") < C.MAX_RULE_FILE_BYTES).withColumn("n", F.row_number().over(order)).withColumn("total", F.sum("size").over(order))
    files = files.filter((F.col("n") <= C.MAX_RULE_FILES) & (F.col("total") <= C.MAX_RULE_BYTES))
    lines = files.select("repo_id", "seq", P.dirname(F.col("path")).alias("scope"), F.posexplode(F.split("content", "\n", -1)).alias("line", "pattern"))
    lines = lines.filter(~is_blank(F.col("pattern")) & ~F.startswith(F.ltrim("pattern"), F.lit("#")))
    lines = lines.withColumn("ord", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq", "line"))).filter(F.col("ord") <= C.MAX_RULES)

    def run(batches):
        for pdf in batches:
            parsed = [rule_regex(p) for p in pdf["pattern"]]
            pdf["regex"] = [x[0] if x else None for x in parsed]
            pdf["negated"] = [x[1] if x else None for x in parsed]
            yield pdf[["repo_id", "scope", "ord", "pattern", "regex", "negated"]]

    out = lines.select("repo_id", "scope", "ord", "pattern").mapInPandas(run, "repo_id string, scope string, ord int, pattern string, regex string, negated boolean")
    return out.filter("regex IS NOT NULL").withColumn("depth", F.when(F.col("scope") == "", 0).otherwise(F.size(F.split("scope", "/"))))


#: Paths that one task holds of a repository.
PATHS_TOGETHER = 20_000


def ignored_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path) that the rules ignore: of the rules that fit, deepest scope then last rule wins.

    A scope's rules are one trie, built once for each part of a repository's paths; a path walks the tries of the folders
    above it, the deepest first, until one decides. Parts are of bounded size, and a repository's rules within its budget."""
    return marked_paths(files, rules.withColumn("hit", F.lit("ignored"))).select("repo_id", "path")


def marked_paths(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo_id, path, hit): as ignored_paths, with rules of several kinds (hit) that decide each for itself; of the kinds that
    ignore a path the greatest is named."""
    paths = files.select("repo_id", "path").join(rules.select("repo_id").distinct(), "repo_id", "left_semi")
    parts = paths.groupBy("repo_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(PATHS_TOGETHER)).cast("int").alias("parts"))
    dealt = paths.join(parts, "repo_id").select("repo_id", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int").alias("part"), "path")
    copied = rules.join(parts, "repo_id").select("repo_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hit", "scope", "ord", "pattern", "regex", "negated")
    schema = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("hit", pa.string())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tries: dict[str, dict[str, RuleTrie]] = {}
        for r in right.to_pylist():
            tries.setdefault(r["hit"], {}).setdefault(r["scope"], RuleTrie()).add(r["ord"], r["pattern"], r["regex"], r["negated"])
        out = []
        for path in dict.fromkeys(left.column("path").to_pylist()):
            hits = [hit for hit, scopes in tries.items() if _ignores(scopes, path)]
            if hits:
                out.append((left.column("repo_id")[0].as_py(), path, max(hits)))
        return pa.Table.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(3)], schema=schema)

    return dealt.groupBy("repo_id", "part").cogroup(copied.groupBy("repo_id", "part")).applyInArrow(run, "repo_id string, path string, hit string")


def _ignores(scopes: dict[str, RuleTrie], path: str) -> bool:
    at = path.rfind("/")
    while True:
        scope = path[:at] if at > 0 else ""
        found = scopes[scope].last(path[at + 1 :] if at > 0 else path) if scope in scopes else None
        if found:
            return not found[1]
        if not scope:
            return False
        at = path.rfind("/", 0, at)


def linguist_patterns(attribute_files: DataFrame) -> DataFrame:
    """attribute files (repo_id, seq, path, size, content) as rule files of the patterns flagged generated or vendored."""
    parts = lambda line: F.split(F.trim(line), r"\s+")
    flagged = lambda line: F.exists(F.slice(parts(line), F.lit(2), F.size(parts(line))), lambda a: a.rlike(r"^linguist-(generated|vendored)(=true)?$"))
    lines = F.filter(F.split("content", "\n", -1), lambda line: ~F.startswith(F.trim(line), F.lit("#")) & (F.trim(line) != "") & flagged(line))
    return attribute_files.withColumn("content", F.array_join(F.transform(lines, lambda line: parts(line)[0]), "\n")).filter("content <> ''")


# --- budget, readme, statistics -------------------------------------------------------------------------------


def readme_paths(files: DataFrame) -> DataFrame:
    """(repo_id, readme_path): the shallowest, then shortest, then first."""
    found = files.filter(P.basename(F.col("path")).rlike(C.README_NAME))
    return found.groupBy("repo_id").agg(F.min_by("path", F.struct(P.depth(F.col("path")).alias("d"), F.length("path").alias("n"), F.col("seq"))).alias("readme_path"))


def greedy_trim(files: DataFrame, limit: int = C.MAX_TOTAL_BYTES) -> DataFrame:
    """Adds kept. Readme first, then importance, then short before long; a file that does not fit is passed over.

    files: repo_id, seq, path, bytes, chars, importance, is_readme. One fold per repository over (rank, bytes) structs:
    the texts stay out of it."""
    item = F.struct(F.when(F.col("is_readme"), 0).otherwise(1).alias("a"), (-F.col("importance")).alias("b"), F.col("chars").alias("c"), F.col("seq").alias("seq"), F.col("bytes").alias("bytes"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["bytes"] <= limit
        return F.struct(
            F.when(fits, acc["used"] + x["bytes"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.array_append(acc["kept"], x["seq"].cast("long"))).otherwise(acc["kept"]).alias("kept"),
        )

    folded = files.groupBy("repo_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, lambda a: a["kept"]).alias("seqs"), F.sum("bytes").alias("total"))
    kept = folded.select("repo_id", F.explode("seqs").alias("seq"), F.lit(True).alias("kept"))
    return files.join(kept, ["repo_id", "seq"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def ingest_stats(files: DataFrame, skipped: DataFrame) -> DataFrame:
    """A1: counts and UTF-8 bytes per repository; skipped entries beyond the listing cap are only counted."""
    kept = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("included_files"), F.sum(F.octet_length("content")).alias("included_bytes"))
    out = skipped.groupBy("repo_id").agg(F.count(F.lit(1)).alias("skipped_entries"))
    out = out.withColumn("unlisted_skipped", F.greatest(F.col("skipped_entries") - C.MAX_LISTED_SKIPS, F.lit(0)))
    return kept.join(out, "repo_id", "full").na.fill(0, ["included_files", "included_bytes", "skipped_entries", "unlisted_skipped"])


def language_shares(files: DataFrame, least: float = 0.03, most: int = 5) -> DataFrame:
    """A2: a repository's code languages by share of bytes: at least 3 %, at most five, in whole percent."""
    code = files.filter(~F.col("category").isin("config", "docs", "data", "test"))
    sums = code.groupBy("repo_id", "language").agg(F.sum("bytes").alias("bytes"), F.min("seq").alias("first"))
    whole = Window.partitionBy("repo_id")
    share = F.when(F.sum("bytes").over(whole) > 0, F.col("bytes") / F.sum("bytes").over(whole)).otherwise(F.lit(0.0))
    ranked = sums.withColumn("share", share).filter(F.col("share") >= least)
    ranked = ranked.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("bytes"), "first")))
    return ranked.filter(F.col("rank") <= most).select("repo_id", "language", F.floor(F.col("share") * 100 + 0.5).cast("int").alias("percent"), "rank")


def limit_listing(skipped: DataFrame, most: int = C.MAX_LISTED_SKIPS) -> DataFrame:
    """The first entries of each repository, by seq."""
    return skipped.withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("seq"))).filter(F.col("n") <= most).drop("n")
