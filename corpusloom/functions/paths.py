"""Column functions over file paths: parts, verdicts, languages, categories and scores. All JVM-side expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import constants as C


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def matches(c: Column, patterns: list[str]) -> Column:
    return any_of([c.rlike(p) for p in patterns])


def basename(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What precedes the last slash, or nothing."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit(""))


def extension(path: Column) -> Column:
    """Lower-cased; a leading dot begins no extension."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+\.([^.]*)\z", 1))


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def folder_names(path: Column) -> Column:
    """Lower-cased names of the folders above."""
    s = segments(path)
    return F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda x: F.lower(x))


def in_folder(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(folder_names(path), F.lit(names))


def depth(path: Column) -> Column:
    return F.size(segments(path)) - 1


def normalize_path(path: Column) -> Column:
    """Without empty, "." and ".." segments; null where it leaves the root."""

    def step(acc: Column, s: Column) -> Column:
        out, ok = acc["out"], acc["ok"]
        up, stay = s == "..", (s == "") | (s == ".")
        popped = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
        return F.struct(
            F.when(stay, out).when(up, popped).otherwise(F.concat(out, F.array(s))).alias("out"),
            (ok & ~(up & (F.size(out) == 0))).alias("ok"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(True).alias("ok"))
    return F.aggregate(segments(path), start, step, lambda acc: F.when(acc["ok"], F.array_join(acc["out"], "/")))


def join_path(folder: Column, rel: Column) -> Column:
    """Rel as seen from folder."""
    return normalize_path(F.when(folder == "", rel).otherwise(F.concat(folder, F.lit("/"), rel)))


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def folder_verdicts(path: Column) -> Column:
    """For each folder of a path, the reason to skip it, or null."""
    by_name = _literal_map({d: reason for reason, names in C.SKIPPED_DIRS.items() for d in names.split()})
    s = segments(path)

    def reason(seg: Column) -> Column:
        out = F.try_element_at(by_name, seg)
        for suffix, why in C.SKIPPED_DIR_SUFFIXES.items():
            out = F.coalesce(out, F.when(F.endswith(seg, F.lit(suffix)), F.lit(why)))
        return out

    return F.transform(F.slice(s, F.lit(1), F.size(s) - 1), reason)


def is_secret_name(path: Column) -> Column:
    """F2."""
    low, ext = F.lower(basename(path)), extension(path)
    env = (low == ".env") | F.startswith(low, F.lit(".env."))
    return low.isin(C.SECRET_NAMES) | ext.isin(C.SECRET_EXTENSIONS) | F.when(env, ~low.rlike(C.ENV_TEMPLATE)).otherwise(F.endswith(low, F.lit(".env")))


def path_verdict(path: Column, size: Column) -> Column:
    """struct of reason (null: keep) and dir_depth (index of the folder that decided, null if none)."""
    reasons = folder_verdicts(path)
    hits = F.filter(F.transform(reasons, lambda r, i: F.struct(i.alias("at"), r.alias("reason"))), lambda x: x["reason"].isNotNull())
    first = F.try_element_at(hits, F.lit(1))
    low, ext = F.lower(basename(path)), extension(path)
    of_file = (
        F.when(low.isin(C.LOCKFILES), F.lit("lockfile"))
        .when(low.isin(C.NOISE_NAMES) | ext.isin(C.NOISE_EXTENSIONS), F.lit("cache"))
        .when(low.isin(C.HOUSEKEEPING_NAMES) | path.rlike(C.HOUSEKEEPING_DIRS), F.lit("housekeeping"))
        .when(is_secret_name(path), F.lit("secret"))
        .when(ext.isin(C.ASSET_EXTENSIONS), F.lit("asset"))
        .when(ext.isin(C.BINARY_EXTENSIONS), F.lit("binary"))
        .when(ext.isin(C.DATA_FILE_EXTENSIONS), F.lit("data"))
        .when(low.rlike(C.MINIFIED_NAME) | (ext == "map"), F.lit("generated"))
        .when(low.rlike(C.GENERATED_NAME) | F.endswith(low, F.lit("_pb2.py")), F.lit("generated"))
        .when((low == "next-env.d.ts") | F.endswith(low, F.lit(".tsbuildinfo")), F.lit("generated"))
        .when(size == 0, F.lit("empty"))
        .when((size > C.MAX_FILE_BYTES) & ext.isin(C.LARGE_DATA_EXTENSIONS), F.lit("data"))
        .when(size > C.MAX_FILE_BYTES, F.lit("too-large"))
        .when(ext.isin("json", "xml") & (size > C.MAX_DATA_BYTES), F.lit("data"))
    )
    return F.struct(F.coalesce(first["reason"], of_file).alias("reason"), first["at"].alias("dir_depth"))


def language(path: Column) -> Column:
    """P3."""
    low = F.lower(basename(path))
    by_ext = _literal_map({e: lang for lang, exts in C.LANGUAGES.items() for e in exts.split()})
    return F.coalesce(
        F.try_element_at(_literal_map(C.NAME_LANGUAGES), low),
        F.when(F.startswith(low, F.lit("dockerfile")), F.lit("Dockerfile")),
        F.try_element_at(by_ext, extension(path)),
        F.lit("Text"),
    )


def is_test(path: Column) -> Column:
    return matches(path, C.TEST_PATTERNS)


def is_config(path: Column) -> Column:
    """P6."""
    low = F.lower(basename(path))
    return low.isin(C.CONFIG_NAMES) | matches(low, C.CONFIG_PATTERNS) | path.rlike(C.CONFIG_DIRS) | (path.rlike(C.INFRA_DIRS) & low.rlike(C.INFRA_FILE))


def is_route(path: Column, has_expo_router: Column | None = None) -> Column:
    """P5. has_expo_router: whether the repository depends on that package."""
    low = F.lower(path)
    base, ext = basename(low), extension(low)
    in_app = low.rlike(r"(^|/)app/")
    return (ext.isin(C.CODE_EXTENSIONS) | (ext == "html")) & any_of(
        [
            in_app & base.rlike(C.APP_ROUTE_FILE),
            (F.lit(False) if has_expo_router is None else has_expo_router) & in_app & base.rlike(r"\.(t|j)sx?$"),
            low.rlike(r"(^|/)(pages|routes)/") & ~low.rlike(r"(^|/)(components|lib|utils)/"),
            low.rlike(r"(^|/)src/routes/"),
            low.rlike(r"(^|/)server/(api|routes)/"),
            low.rlike(C.SERVER_ROUTE_DIRS),
            base.rlike(C.ROUTE_NAME),
            base.rlike(C.ROUTE_SUFFIX),
        ]
    )


def category(path: Column, has_expo_router: Column | None = None) -> Column:
    """The first rule that fits."""
    base, ext = basename(path), extension(path)
    low = F.lower(base)
    code = ext.isin(C.CODE_EXTENSIONS)
    return (
        F.when(is_test(path), F.lit("test"))
        .when(is_config(path), F.lit("config"))
        .when(ext.isin(C.DOC_EXTENSIONS) | path.rlike(r"(?i)(^|/)docs?/"), F.when(code, F.lit("helper")).otherwise(F.lit("docs")))
        .when(ext.isin(C.STYLE_EXTENSIONS) | low.rlike(r"\.css\.(ts|js)$"), F.lit("style"))
        .when((in_folder(path, C.SCRIPT_DIRS) & ~in_folder(path, C.NOT_SCRIPT_DIRS)) | path.rlike(r"(?i)^(tools|tooling)/"), F.lit("script"))
        .when(ext.isin(C.SCRIPT_EXTENSIONS), F.lit("script"))
        .when(in_folder(path, C.MIGRATION_DIRS), F.lit("data"))
        .when(is_route(path, has_expo_router), F.lit("route"))
        .when(ext.isin(C.DATA_EXTENSIONS), F.when(~F.contains(path, F.lit("/")) | F.startswith(low, F.lit(".")) | low.rlike(r"^taskfile\."), F.lit("config")).otherwise(F.lit("data")))
        .when(in_folder(path, C.STATIC_DIRS) & code, F.lit("component"))
        .when(ext.isin(C.TEMPLATE_EXTENSIONS), F.lit("component"))
        .when(in_folder(path, C.HELPER_DIRS) | low.rlike(r"\.d\.ts$") | low.rlike(C.HELPER_NAME) | base.rlike(C.HOOK_NAME), F.lit("helper"))
        .when(ext.isin(C.COMPONENT_EXTENSIONS) | in_folder(path, C.COMPONENT_DIRS), F.lit("component"))
        .when(ext.isin("tsx", "jsx") & ~in_folder(path, C.LOGIC_DIRS), F.lit("component"))
        .when(code | (ext == ""), F.lit("core"))
        .otherwise(F.lit("data"))
    )


def is_entry_path(path: Column, src_has_main: Column, deps: Column | None = None) -> Column:
    """P7. src_has_main: the repository has src/main.* or src/index.*; deps: names it depends on."""
    base, s = basename(path), segments(path)
    level = F.size(s) - 1
    parent = F.lower(F.coalesce(F.try_element_at(s, F.lit(-2)), F.lit("")))
    depends = lambda name: F.lit(False) if deps is None else F.coalesce(F.array_contains(deps, name), F.lit(False))
    named = matches(base, C.ENTRY_NAMES) & ((level == 0) | ((level == 1) & parent.isin(C.ENTRY_PARENTS) & ~((parent == "lib") & src_has_main)))
    return any_of(
        [
            path.rlike(r"^(src/)?app/(layout|page)\.(t|j)sx?$"),
            path.rlike(r"^(src/)?pages/(_app|index)\.(t|j)sx?$"),
            depends("next") & path.rlike(r"^(src/)?(middleware|proxy)\.(t|j)s$"),
            depends("expo-router") & path.rlike(r"^(src/)?app/_layout\.(t|j)sx?$"),
            path.rlike(r"^src/(main|lib)\.rs$"),
            path.rlike(r"^cmd/[^/]+/main\.go$") | (path == "main.go"),
            path.rlike(r"^lib/main\.dart$"),
            (base == "__main__.py") & (level <= 2),
            (level == 2) & (s[0] == "src") & base.rlike(r"^(main|app|server|cli)\.py$"),
            named,
        ]
    )


def importance(path: Column, kind: Column, is_entry: Column, lines: Column, n_imports: Column, n_importers: Column) -> Column:
    """P8."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in C.CATEGORY_WEIGHTS.items() for x in kv]), kind), F.lit(0))
    surface = (kind == "route") | is_entry
    return (
        weight
        + F.when(is_entry, 40).otherwise(0)
        + F.least(F.lit(36), n_importers * 6)
        + F.least(F.when(surface, 24).otherwise(14), n_imports * 2)
        + F.when((kind == "route") & path.rlike(r"(^|/)api/") & (lines > 60), 8).otherwise(0)
        + F.when(lines >= 20, 8).when(lines < 8, -6).otherwise(0)
        + F.when(lines > 60, F.least(F.lit(12), F.floor(F.log2(lines / F.lit(60.0)) * 4 + 0.5).cast("int"))).otherwise(0)
        - F.greatest(F.lit(0), depth(path) - 2) * 2
        + F.when(path.rlike(C.NAME_SIGNAL), 4).otherwise(0)
    ).cast("int")
