"""The import graph: statements to candidate paths, the first that exists, edges both ways, and what follows from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpusloom.functions import constants as C
from corpusloom.functions import paths as P

# --- fixed values: import statements; every repetition has a bound ----------------------------------------------
JS_IMPORTS = (
    r"""(?:^|[^\w$.])(?:(?:import|export)\s[^'"`;]{0,400}?\sfrom\s*|import\s*|require\(\s*(?=['"][^'"\n]{1,300}['"]\s*\))|import\(\s*(?=['"][^'"\n]{1,300}['"]\s*\)))"""
    r"""['"]([^'"\n]{1,300})['"]"""
)
HTML_LINKS = r"""<(?:script|link)\b[^<>]{1,500}?(?:src|href)=["']([^"':]{1,300})["']"""
CSS_IMPORTS = r"""@(?:import|use|forward)\s+(?:url\(\s*)?['"]([^'"\n]{1,300})['"]"""
PY_IMPORTS = r"(?m)^[ \t]*import[ \t]+([\w.]+(?:[ \t]*,[ \t]*[\w.]+)*)"
PY_FROM = r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import[ \t]+(\([^()]{0,4000}\)|[^\n#]+)"
GO_BLOCK = r"import\s*\(([^()]{0,8000})\)"
GO_LINE = r"""import\s+(?:[\w.]+\s+)?"([^"]+)\""""
RUBY_REQUIRE = r"""require(_relative)?\s*(?:\(\s*)?['"]([^'"\n]{1,300})['"]"""
RUST_MOD = r"(?m)^\s*(?:pub(?:\([\w:]+\))?\s+)?mod\s+(\w+)\s*;"
RUST_USE = r"(?m)^\s*(?:pub\s+)?use\s+crate::([\w:]+)"
C_INCLUDE = r"""(?m)^\s*#\s*include\s+"([^"]+)\""""
PHP_INCLUDE = r"""(?:require|include)(?:_once)?\s*(?:\(\s*)?(?:__DIR__\s*\.\s*)?['"]([^'"\n]{1,300}\.php)['"]"""
PHP_USE = r"(?m)^\s*use\s+([\w\\]+)\s*;"
JVM_IMPORT = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;?"
DART_IMPORT = r"""(?m)^\s*(?:import|export|part)\s+['"]([^'"]+)['"]"""
JS_RESOLVE = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".vue", ".svelte", ".astro", ".json", ".css", ".scss"]
JS_SWAPS = [".ts", ".tsx", ".mts", ".cts"]
JS_TAILS = JS_RESOLVE + ["/index" + e for e in JS_RESOLVE[1:]]
JS_SWAPPED = r"(?s)^(.*)\.(m|c)?jsx?$"
JS_ENDING = rf"(?:/index)?\.(?:{'|'.join(e[1:] for e in JS_RESOLVE[1:])})\z"
C_EXTENSIONS = "c h cc cpp cxx hpp hh m mm".split()
FALLBACK_ALIASES = [("@/", ["src", ""]), ("~/", ["src", "app", ""]), ("$lib/", ["src/lib"])]
CONFIG_MANIFESTS = r"^(tsconfig|jsconfig)(\.[\w-]+)?\.json$"

CANDIDATES = "repo_id string, src string, ord long, rank int, candidate string"


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def js_candidates(base: Column) -> Column:
    """Ordered paths that a specifier without a known ending may mean."""
    plain = [F.concat(base, F.lit(e)) for e in JS_TAILS]
    stem = F.regexp_extract(base, JS_SWAPPED, 1)
    swapped = [F.when(base.rlike(JS_SWAPPED), F.concat(stem, F.lit(e))) for e in JS_SWAPS]
    return F.array(*plain, *swapped)


def js_stem(path: Column) -> Column:
    """A path without an ending of JS_RESOLVE, and without the /index before one."""
    return F.regexp_replace(path, JS_ENDING, "")


def candidate_stems(base: Column) -> Column:
    """The stems that js_candidates(base) have, four at most where the candidates are 33: a join on stems keeps to few rows."""
    no_index = lambda c: F.regexp_replace(c, r"/index\z", "")
    swapped = F.when(base.rlike(JS_SWAPPED), no_index(F.regexp_extract(base, JS_SWAPPED, 1)))
    return F.array_distinct(F.array_compact(F.array(base, js_stem(base), no_index(base), swapped)))


def candidate_place(base: Column, path: Column) -> Column:
    """The place of a path among js_candidates(base), from 1, or 0. Only paths that do not begin as the base does need the list."""
    tail = F.substring(path, F.length(base) + 1, F.length(path))
    return F.when(F.startswith(path, base), F.array_position(F.lit(JS_TAILS), tail)).otherwise(F.array_position(js_candidates(base), path))


def js_specifiers(text: Column) -> Column:
    """G1: the specifiers of import, export-from, require and dynamic import in the order of the text, without query strings."""
    return F.transform(all_matches(text, JS_IMPORTS), lambda s: F.substring_index(s, "?", 1))


def _bases(specs: Column, folder: Column, aliases: Column) -> Column:
    """For each specifier the base paths to try, in order: relative, from the root, or by alias and base url."""

    def of(spec: Column) -> Column:
        relative = F.startswith(spec, F.lit("./")) | F.startswith(spec, F.lit("../")) | spec.isin(".", "..")
        by_alias = F.flatten(
            F.transform(
                F.filter(aliases, lambda a: (spec == a["prefix"]) | F.startswith(spec, F.when(F.endswith(a["prefix"], F.lit("/")) | (a["prefix"] == ""), a["prefix"]).otherwise(F.concat(a["prefix"], F.lit("/"))))),
                lambda a: F.transform(a["targets"], lambda t: P.join_path(t, F.regexp_replace(F.substring(spec, F.length(a["prefix"]) + 1, F.length(spec)), "^/", ""))),
            )
        )
        return F.when(relative, F.array(P.join_path(folder, spec))).when(F.startswith(spec, F.lit("/")), F.array(P.normalize_path(spec))).otherwise(by_alias)

    return F.transform(specs, of)


NO_ALIASES = "array<struct<prefix:string,targets:array<string>>>"


def _ranked(files: DataFrame, groups: Column) -> DataFrame:
    """groups: array of arrays of candidates, each group one statement."""
    stated = files.select("repo_id", F.col("path").alias("src"), F.posexplode(groups).alias("ord", "options"))
    return stated.select("repo_id", "src", F.col("ord").cast("long").alias("ord"), F.posexplode("options").alias("rank", "candidate")).filter("candidate IS NOT NULL AND candidate <> ''")


def candidate_paths(files: DataFrame, aliases: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """(repo_id, src, ord, rank, candidate) of every import statement; of a statement (ord) the lowest rank counts.

    files: repo_id, path, content. aliases: repo_id, scope, prefix, targets. hints: repo_id, go_module, py_roots, psr4,
    dart_package. Statements that may hit several files get one ord for each."""
    text, path = F.col("content"), F.col("path")
    folder, ext = P.dirname(path), P.extension(path)
    files = files.select("repo_id", "path", "content").withColumn("ext", ext)
    files = files.join(hints, "repo_id", "left") if hints is not None else files
    for name, kind in (("go_module", "string"), ("py_roots", "array<string>"), ("psr4", "array<struct<prefix:string,dir:string>>"), ("dart_package", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    if aliases is not None:
        order = F.struct((-F.length("scope")).alias("a"), (-F.length("prefix")).alias("b"), F.col("prefix").alias("prefix"), F.col("targets").alias("targets"), F.col("scope").alias("scope"))
        per_repo = aliases.groupBy("repo_id").agg(F.array_sort(F.collect_list(order)).alias("listed"))
        files = files.join(per_repo, "repo_id", "left")
        near = F.filter(F.coalesce("listed", F.array().cast("array<struct<a:int,b:int,prefix:string,targets:array<string>,scope:string>>")), lambda a: (a["scope"] == "") | F.startswith(F.col("path"), F.concat(a["scope"], F.lit("/"))))
        known = F.transform(near, lambda a: F.struct(a["prefix"].alias("prefix"), a["targets"].alias("targets")))
    else:
        known = F.array().cast(NO_ALIASES)
    fallback = F.array(*[F.struct(F.lit(p).alias("prefix"), F.array(*map(F.lit, t)).alias("targets")) for p, t in FALLBACK_ALIASES])
    files = files.withColumn("known", F.concat(known, fallback))
    # one pass: the extension decides which statements a file can have
    js, none = _javascript(text, folder), F.array().cast("array<array<string>>")
    by_kind = [
        (F.col("ext") == "html", F.concat(js, _page_links(text, folder))),
        (F.col("ext").isin(C.JS_EXTENSIONS), js),
        (F.col("ext").isin(C.STYLE_EXTENSIONS), _stylesheets(text, folder)),
        (F.col("ext").isin("py", "ipynb"), _python(text, folder)),
        (F.col("ext") == "rb", _ruby(text, folder)),
        (F.col("ext") == "rs", _rust(text, path, folder)),
        (F.col("ext").isin(C_EXTENSIONS), F.transform(all_matches(text, C_INCLUDE), lambda s: F.array(P.join_path(folder, s), P.join_path(F.lit("include"), s), P.join_path(F.lit("src"), s), P.normalize_path(s)))),
        (F.col("ext") == "php", _php(text, folder)),
        (F.col("ext") == "dart", _dart(text, folder)),
    ]
    groups = none
    for when, found in reversed(by_kind):
        groups = F.when(when, found).otherwise(groups)
    return _ranked(files, groups)


def _javascript(text: Column, folder: Column) -> Column:
    bases = _bases(js_specifiers(text), folder, F.col("known"))
    return F.transform(bases, lambda options: F.flatten(F.transform(F.filter(options, lambda b: b.isNotNull()), js_candidates)))


def _page_links(text: Column, folder: Column) -> Column:
    return F.transform(all_matches(text, HTML_LINKS), lambda s: F.array(P.join_path(folder, F.regexp_replace(s, "^/", ""))))


def _stylesheets(text: Column, folder: Column) -> Column:
    specs = F.filter(all_matches(text, CSS_IMPORTS), lambda s: ~F.startswith(s, F.lit("http")))
    bases = F.filter(F.transform(specs, lambda s: P.join_path(folder, s)), lambda b: b.isNotNull())
    return F.transform(bases, lambda b: F.array(b, F.concat(b, F.lit(".css")), F.concat(b, F.lit(".scss")), F.concat(F.regexp_replace(b, r"([^/]+)$", "_$1"), F.lit(".scss")), F.concat(b, F.lit(".less"))))


def _ruby(text: Column, folder: Column) -> Column:
    rel, names = all_matches(text, RUBY_REQUIRE, 1), all_matches(text, RUBY_REQUIRE, 2)
    with_ext = F.transform(names, lambda s: F.when(F.endswith(s, F.lit(".rb")), s).otherwise(F.concat(s, F.lit(".rb"))))
    return F.zip_with(rel, with_ext, lambda r, s: F.when(r != "", F.array(P.join_path(folder, s))).otherwise(F.array(P.join_path(F.lit("lib"), s), P.join_path(F.lit("app"), s), P.normalize_path(s))))


def _rust(text: Column, path: Column, folder: Column) -> Column:
    home = F.when(P.basename(path).rlike(r"^(main|lib|mod)\.rs$"), folder).otherwise(F.regexp_replace(path, r"\.rs$", ""))
    mods = F.transform(all_matches(text, RUST_MOD), lambda m: F.array(P.join_path(home, F.concat(m, F.lit(".rs"))), P.join_path(home, F.concat(m, F.lit("/mod.rs")))))

    def uses(m: Column) -> Column:
        steps = F.filter(F.split(m, "::"), lambda x: x != "")
        heads = F.transform(F.reverse(F.sequence(F.lit(1), F.size(steps))), lambda n: F.concat(F.lit("src/"), F.array_join(F.slice(steps, F.lit(1), n), "/")))
        return F.when(F.size(steps) > 0, F.flatten(F.transform(heads, lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))))).otherwise(F.array().cast("array<string>"))

    return F.concat(mods, F.transform(all_matches(text, RUST_USE), uses))


def _php(text: Column, folder: Column) -> Column:
    included = F.transform(all_matches(text, PHP_INCLUDE), lambda s: F.array(P.join_path(folder, F.regexp_replace(s, "^/", ""))))
    spaces = F.coalesce("psr4", F.array().cast("array<struct<prefix:string,dir:string>>"))

    def places(fq: Column) -> Column:
        own = F.filter(spaces, lambda r: F.startswith(fq, r["prefix"]))
        inner = lambda r: F.replace(F.substring(fq, F.length(r["prefix"]) + 1, F.length(fq)), F.lit("\\"), F.lit("/"))
        return F.transform(own, lambda r: F.array(P.normalize_path(F.concat(r["dir"], F.lit("/"), inner(r), F.lit(".php")))))

    return F.concat(included, F.flatten(F.transform(all_matches(text, PHP_USE), places)))


def _dart(text: Column, folder: Column) -> Column:
    own = F.concat(F.lit("package:"), F.coalesce("dart_package", F.lit("\x00")), F.lit("/"))
    stated = F.filter(all_matches(text, DART_IMPORT), lambda s: ~F.startswith(s, F.lit("dart:")))
    return F.transform(stated, lambda s: F.array(F.when(F.startswith(s, own), F.concat(F.lit("lib/"), F.substring(s, F.length(own) + 1, F.length(s)))).when(~F.startswith(s, F.lit("package:")), P.join_path(folder, s))))


def _python(text: Column, folder: Column) -> Column:
    """Each root may hit, so each root is a statement of its own."""
    roots = F.coalesce("py_roots", F.array(F.lit("")))
    plain = F.transform(F.flatten(F.transform(all_matches(text, PY_IMPORTS), lambda m: F.split(m, ","))), lambda m: F.trim(m))
    mods, names = all_matches(text, PY_FROM, 1), all_matches(text, PY_FROM, 2)

    def imported(mod: Column, listed: Column) -> Column:
        each = F.transform(F.split(F.regexp_replace(listed, r"[()]", ""), ","), lambda s: F.split(F.trim(F.regexp_replace(s, r"\s+", " ")), " ")[0])
        good = F.filter(each, lambda n: n.rlike(r"^\w+$"))
        return F.concat(F.when(F.replace(mod, F.lit("."), F.lit("")) != "", F.array(mod)).otherwise(F.array().cast("array<string>")), F.transform(good, lambda n: F.concat(mod, F.when(F.endswith(mod, F.lit(".")), F.lit("")).otherwise(F.lit(".")), n)))

    modules = F.concat(plain, F.flatten(F.zip_with(mods, names, imported)))

    def options(m: Column) -> Column:
        dots = F.length(F.regexp_extract(m, r"^\.*", 0))
        name = F.replace(F.substring(m, dots + 1, F.length(m)), F.lit("."), F.lit("/"))
        up = F.array_join(F.slice(P.segments(folder), F.lit(1), F.greatest(F.size(P.segments(folder)) - (dots - 1), F.lit(0))), "/")
        bases = F.when(dots > 0, F.array(up)).otherwise(roots)

        def hits(b: Column) -> Column:
            p = F.when(name == "", b).when(b == "", name).otherwise(F.concat(b, F.lit("/"), name))
            return F.array(P.normalize_path(F.concat(p, F.lit(".py"))), P.normalize_path(F.concat(p, F.lit("/__init__.py"))))

        return F.transform(bases, hits)

    return F.flatten(F.transform(modules, options))


def folder_imports(files: DataFrame, hints: DataFrame) -> DataFrame:
    """Imports that name a folder (Go) or a class (Java, Kotlin, Scala): (repo_id, src, ord, dst), many per statement."""
    text = F.col("content")
    go = files.filter(P.extension(F.col("path")) == "go").join(hints.select("repo_id", "go_module"), "repo_id").filter("go_module IS NOT NULL")
    blocks = F.flatten(F.transform(all_matches(text, GO_BLOCK), lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), F.lit(1))))
    stated = go.select("repo_id", F.col("path").alias("src"), "go_module", F.posexplode(F.concat(blocks, all_matches(text, GO_LINE))).alias("ord", "spec"))
    stated = stated.filter(F.startswith(F.col("spec"), F.concat("go_module", F.lit("/")))).withColumn("folder", F.substring(F.col("spec"), F.length("go_module") + 2, F.length("spec")))
    targets = files.select("repo_id", F.col("path").alias("dst"), P.dirname(F.col("path")).alias("folder")).filter(F.endswith(F.col("dst"), F.lit(".go")) & ~F.endswith(F.col("dst"), F.lit("_test.go")))
    by_folder = stated.join(targets, ["repo_id", "folder"]).select("repo_id", "src", "ord", "dst")
    jvm = files.filter(P.extension(F.col("path")).isin("java", "kt", "scala"))
    named = jvm.select("repo_id", F.col("path").alias("src"), F.posexplode(all_matches(text, JVM_IMPORT)).alias("ord", "name"))
    named = named.withColumn("stem", F.substring_index("name", ".", -1)).withColumn("suffix", F.replace("name", F.lit("."), F.lit("/")))
    classes = jvm.select("repo_id", F.col("path").alias("dst"), F.regexp_extract(P.basename(F.col("path")), r"^(\w+)\.(java|kt|scala)$", 1).alias("stem"))
    by_class = named.join(classes, ["repo_id", "stem"]).filter(F.endswith(F.regexp_replace("dst", r"\.(java|kt|scala)$", ""), F.col("suffix"))).select("repo_id", "src", "ord", "dst")
    return by_folder.unionByName(by_class).filter("src <> dst")


def import_edges(files: DataFrame, candidates: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(repo_id, src, dst, ord): of each statement the first candidate that exists; no loops, no repeats."""
    exists = files.select("repo_id", F.col("path").alias("candidate"))
    found = candidates.join(exists, ["repo_id", "candidate"])
    first = found.groupBy("repo_id", "src", "ord").agg(F.min_by("candidate", "rank").alias("dst"))
    if more is not None:
        first = first.select("repo_id", "src", "ord", "dst").unionByName(more.select("repo_id", "src", F.col("ord").cast("long").alias("ord"), "dst"))
    return first.filter("src <> dst").groupBy("repo_id", "src", "dst").agg(F.min("ord").alias("ord"))


def imported_by(edges: DataFrame) -> DataFrame:
    """(repo_id, path, importers in order of path)."""
    return edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("importers"))


def kept_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges whose both ends were kept (repo_id, path)."""
    ends = kept.select("repo_id", "path")
    return edges.join(ends.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_semi").join(ends.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_semi")


def degrees(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds n_imports and n_importers."""
    out = edges.groupBy("repo_id", F.col("src").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("n_imports"))
    into = edges.groupBy("repo_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("n_importers"))
    return files.join(out, ["repo_id", "path"], "left").join(into, ["repo_id", "path"], "left").na.fill(0, ["n_imports", "n_importers"])


def promote_scripts(files: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """The least fixpoint: a script that a file other than a script imports becomes core. files: repo_id, path, category.

    Each round looks only at scripts that the last round's new core files import, and is checkpointed."""
    scripts = files.filter("category = 'script'").select("repo_id", "path")
    among = edges.join(scripts.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst")
    inner = among.join(scripts.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_semi")
    front = among.join(scripts.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_anti").select("repo_id", F.col("dst").alias("path")).distinct()
    front = checkpointed(front)
    found = front
    for _ in range(max_rounds):
        front = checkpointed(inner.join(front.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_semi").select("repo_id", F.col("dst").alias("path")).distinct().join(found, ["repo_id", "path"], "left_anti"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
    else:
        raise RuntimeError(f"scripts import each other over more than {max_rounds} steps; pass a larger max_rounds")
    new = found.distinct().withColumn("promoted", F.lit(True))
    out = files.join(new, ["repo_id", "path"], "left")
    return out.withColumn("category", F.when(F.col("promoted"), F.lit("core")).otherwise(F.col("category"))).drop("promoted")


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows from a table in the folder that the cluster names, or a local one where it names none: lineage ends there,
    each row is computed once, and readers take the columns that they need. The tables go when the driver ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and sc.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(named or 'file:///tmp/checkpoints/corpusloom').rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def dependencies(files: DataFrame, keys: tuple[str, ...] = ("dependencies", "devDependencies", "peerDependencies")) -> DataFrame:
    """(repo_id, dep, manifest_path) of every package.json."""
    manifests = files.filter(P.basename(F.col("path")) == "package.json").select("repo_id", F.col("path").alias("manifest_path"), clean_json(F.col("content")).alias("json"))
    named = F.flatten(F.array(*[F.coalesce(F.json_object_keys(F.get_json_object("json", f"$.{k}")), F.array().cast("array<string>")) for k in keys]))
    return manifests.select("repo_id", "manifest_path", F.explode(F.array_distinct(named)).alias("dep"))


def clean_json(text: Column) -> Column:
    """JSON without comments and trailing commas. Strings are matched whole, so what they hold stays."""
    string = r'"(?:[^"\\]++|\\.)*+"'
    bare = F.regexp_replace(text, rf"(?s)({string})|//[^\n]*|/\*.*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, rf"(?s)({string})|,(?=\s*[}}\]])", "$1")


def reach_order(files: DataFrame, edges: DataFrame) -> DataFrame:
    """L4: (repo_id, path, reach): depth-first order from entries and routes along imports in source order.

    Depth-first order is sequential, so a repository is one group; it holds paths and edges only, never texts."""
    nodes = files.select("repo_id", "path", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("long").alias("ord"), "is_entry", (F.col("category") == "route").alias("is_route"), "n_importers")
    links = edges.select("repo_id", F.col("src").alias("path"), "dst", F.col("ord").cast("long").alias("ord"), F.lit(None).cast("boolean").alias("is_entry"), F.lit(None).cast("boolean").alias("is_route"), F.lit(None).cast("int").alias("n_importers"))
    schema = T.StructType([T.StructField("repo_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("reach", T.IntegerType())])

    def walk(pdf):
        import pandas as pd

        own = pdf[pdf["dst"].isna()]
        known = set(own["path"])
        out: dict[str, list[str]] = {}
        for r in pdf[pdf["dst"].notna()].sort_values(["path", "ord"]).itertuples():
            out.setdefault(r.path, []).append(r.dst)
        starts = own[(own["is_entry"] == True) | (own["is_route"] == True)]  # noqa: E712
        keyed = sorted((not (bool(r.is_entry) and r.n_importers == 0), not bool(r.is_entry), r.path) for r in starts.itertuples())
        reach: dict[str, int] = {}
        for _, _, start in keyed:
            stack = [start]
            while stack:
                p = stack.pop()
                if p in reach or p not in known:
                    continue
                reach[p] = len(reach)
                stack.extend(reversed(out.get(p, [])))
        return pd.DataFrame({"repo_id": [pdf["repo_id"].iloc[0]] * len(reach), "path": list(reach), "reach": list(reach.values())})

    return nodes.unionByName(links).groupBy("repo_id").applyInPandas(walk, schema)


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(repo_id, path, scope): for each file the deepest folder above it that has a config (repo_id, scope)."""
    s = P.segments(F.col("path"))
    scopes = F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda n: F.array_join(F.slice(s, F.lit(1), n), "/"))
    joined = files.select("repo_id", "path", F.posexplode(scopes).alias("depth", "scope")).join(configs.select("repo_id", "scope").distinct(), ["repo_id", "scope"])
    return joined.groupBy("repo_id", "path").agg(F.max_by("scope", "depth").alias("scope"))


# --- what manifests say about a repository ----------------------------------------------------------------------

COMPILER = "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>"


def alias_table(files: DataFrame) -> DataFrame:
    """(repo_id, scope, prefix, targets) from tsconfig and jsconfig files; a base url is an alias with an empty prefix."""
    configs = files.filter(P.basename(F.col("path")).rlike(CONFIG_MANIFESTS))
    parsed = configs.select("repo_id", P.dirname(F.col("path")).alias("scope"), F.from_json(clean_json(F.col("content")), COMPILER)["compilerOptions"].alias("o"))
    base = F.coalesce(P.join_path(F.col("scope"), F.coalesce("o.baseUrl", F.lit("."))), F.col("scope"))
    parsed = parsed.filter("o IS NOT NULL").withColumn("base", base)
    named = parsed.select("repo_id", "scope", "base", F.explode("o.paths").alias("key", "listed"))
    named = named.select("repo_id", "scope", F.regexp_replace("key", r"\*$", "").alias("prefix"), F.transform("listed", lambda t: F.coalesce(P.join_path(F.col("base"), F.regexp_replace(t, r"\*$", "")), F.lit(""))).alias("targets"))
    plain = parsed.filter("o.baseUrl IS NOT NULL").select("repo_id", F.lit("").alias("scope"), F.lit("").alias("prefix"), F.array("base").alias("targets"))
    return named.unionByName(plain)


def project_hints(files: DataFrame) -> DataFrame:
    """Per repository go_module, py_roots, psr4, dart_package, deps and src_has_main."""
    path, text = F.col("path"), F.col("content")
    at = lambda name: F.max(F.when(path == name, text))
    found = files.groupBy("repo_id").agg(
        at("go.mod").alias("go_mod"),
        at("composer.json").alias("composer"),
        at("pubspec.yaml").alias("pubspec"),
        F.max(path.rlike(r"^src/.*\.py$")).alias("src_py"),
        F.max(path.rlike(r"^src/(main|index)\.")).alias("src_has_main"),
        F.sort_array(F.collect_set(F.when(path.rlike(r"(^|/)(pyproject\.toml|setup\.py)$") & (P.dirname(path) != ""), P.dirname(path)))).alias("py_dirs"),
    )
    first = lambda c, pattern: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    psr4 = F.from_json(F.get_json_object(clean_json(F.col("composer")), "$.autoload.psr-4"), "map<string,string>")
    rules = F.transform(F.map_entries(psr4), lambda e: F.struct(e["key"].alias("prefix"), F.regexp_replace(e["value"], "/$", "").alias("dir")))
    roots = F.concat(F.array(F.lit("")), F.when(F.col("src_py"), F.array(F.lit("src"))).otherwise(F.array().cast("array<string>")), F.flatten(F.transform("py_dirs", lambda d: F.array(d, F.concat(d, F.lit("/src"))))))
    deps = dependencies(files).groupBy("repo_id").agg(F.collect_set("dep").alias("deps"))
    out = found.select(
        "repo_id", first("go_mod", r"(?m)^module\s+(\S+)").alias("go_module"), roots.alias("py_roots"), rules.alias("psr4"),
        first("pubspec", r"(?m)^name:\s*([\w_]+)").alias("dart_package"), "src_has_main",
    )
    return out.join(deps, "repo_id", "left").withColumn("deps", F.coalesce("deps", F.array().cast("array<string>")))


def declared_entries(files: DataFrame) -> DataFrame:
    """(repo_id, path): files that manifests and pages name as starting points."""
    folder, j = P.dirname(F.col("path")), clean_json(F.col("content"))
    base = P.basename(F.col("path"))
    value = lambda p: F.get_json_object("j", p)
    manifests = files.filter(base == "package.json").withColumn("j", j)
    bins = F.when(F.startswith(value("$.bin"), F.lit("{")), F.map_values(F.from_json(value("$.bin"), "map<string,string>"))).otherwise(F.array(value("$.bin")))
    command = r"(?:^|\s)((?:\./)?[\w./-]+\.(?:js|mjs|cjs|ts|mts|py))(?=\s|$)"
    scripts = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(value(f"$.scripts.{k}"), F.lit("")), F.lit(command), F.lit(1)) for k in ("start", "dev", "serve")]))
    exports = F.when(~F.startswith(value("$.exports"), F.lit("{")), value("$.exports"))
    named = manifests.select("repo_id", folder.alias("dir"), F.explode(F.concat(F.array(value("$.main"), value("$.module"), exports), bins, scripts)).alias("spec"))
    pages = files.filter(base == "index.html").select("repo_id", folder.alias("dir"), F.explode(all_matches(F.col("content"), r"""<script[^>]{1,500}?src=["']([^"':]{1,300})["']""")).alias("spec"))
    specs = named.unionByName(pages.withColumn("spec", F.regexp_replace("spec", "^/", ""))).filter("spec IS NOT NULL AND spec <> ''")
    joined = specs.select("repo_id", P.join_path(F.col("dir"), F.regexp_replace("spec", r"^\./", "")).alias("base")).filter("base IS NOT NULL")
    keyed = joined.select("repo_id", "base", F.explode(candidate_stems(F.col("base"))).alias("stem")).distinct()
    pairs = keyed.join(files.select("repo_id", "path", js_stem(F.col("path")).alias("stem")), ["repo_id", "stem"])
    found = pairs.select("repo_id", "base", "path", candidate_place(F.col("base"), F.col("path")).alias("place")).filter("place > 0")
    hit = found.groupBy("repo_id", "base").agg(F.min_by("path", "place").alias("path"))
    block = F.regexp_extract(F.col("content"), r"\[(?:project\.scripts|tool\.poetry\.scripts)\]([\s\S]*?)(?:\n\[|\z)", 1)
    modules = files.filter(base == "pyproject.toml").select("repo_id", F.explode(F.regexp_extract_all(block, F.lit(r"""=\s*["']([\w.]+):"""), F.lit(1))).alias("m"))
    stems = modules.select("repo_id", F.explode(F.array(F.lit(""), F.lit("src/"))).alias("root"), F.replace("m", F.lit("."), F.lit("/")).alias("stem"))
    python = stems.select("repo_id", F.explode(F.array(F.concat("root", "stem", F.lit(".py")), F.concat("root", "stem", F.lit("/__init__.py")))).alias("path"))
    return hit.select("repo_id", "path").unionByName(python.join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")).distinct()
