"""From analysed files to the ordered sections of a tour, with depths, chapters, chunks and word targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import constants as C
from corpusloom.functions import paths as P
from corpusloom.operators import graph as G
from corpusloom.operators import links as K
from corpusloom.operators import plan as PL
from corpusloom.operators import related as RL
from corpusloom.operators import stack as ST


CODE = ("entry", "route", "core", "component", "helper")


def foundations(files: DataFrame) -> DataFrame:
    """L2: adds is_foundation: helpers that a quarter of all code files, four at least, import. files: all that are told."""
    code = F.sum(F.col("category").isin(*CODE).cast("int")).over(Window.partitionBy("repo_id"))
    return files.withColumn("is_foundation", (F.col("category") == "helper") & (F.col("n_importers") >= F.greatest(F.lit(4), F.ceil(code * 0.25))))


def imports_of(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo_id, path): what the given parts (repo_id, path) import."""
    return edges.join(parts.select("repo_id", F.col("path").alias("src")), ["repo_id", "src"], "left_semi").select("repo_id", F.col("dst").alias("path")).distinct()


def told_files(files: DataFrame, readmes: DataFrame) -> DataFrame:
    """The files of a tour: all but the README and trivial ones; of a repository without others, all. Adds is_markup."""
    marks = files.join(readmes.select("repo_id", F.col("readme_path").alias("path"), F.lit(True).alias("is_readme")), ["repo_id", "path"], "left")
    marks = marks.withColumn("told", F.col("is_readme").isNull() & ((F.col("category") == "config") | ~PL.is_trivial(F.col("content"))))
    some = F.max(F.col("told").cast("int")).over(Window.partitionBy("repo_id")) == 1
    marks = marks.withColumn("some", some).filter("told OR NOT some")
    return marks.withColumn("is_markup", PL.is_mostly_markup(F.col("path"), F.col("content"), F.col("lines"))).drop("is_readme", "told", "some")


def rare_names_of(files: DataFrame) -> DataFrame:
    """A4 over the code of a tour."""
    sizes = files.filter(F.col("category").isin(C.CODE_CATEGORIES)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_code"))
    return K.rare_names(K.postings(files), sizes)


def tour(files: DataFrame, edges: DataFrame, readmes: DataFrame, length: str = "medium") -> DataFrame:
    """(repo_id, ord, section_id, kind, chapter, chapter_title, depth, paths): the sections in order.

    Parts of their own by tier (L5), with the host page among the entries (F16), foundations in the core (L2) and the shell
    among the routes (L3); short ones of a folder as one (L7); groups and what overflows (L8); similar screens together (L9);
    a screen's own state after it (J11, L10); chapters shaped, named and split (L11, L12).

    files: as ingested (repo_id, seq, path, content, lines, category, is_entry, n_importers, importance)."""
    budget, keep = C.BUDGETS[length], G.checkpointed
    whole = told_files(files, readmes)
    host = PL.is_host_page(F.col("path"), F.col("content"), F.lit(True))
    # texts are read here, and not again
    told = keep(foundations(whole.withColumn("is_host", host).withColumn("is_list", K.is_registry(F.col("content"))).drop("content", "size", "language")))
    rare = keep(rare_names_of(whole))
    inner = keep(G.kept_edges(edges, told).select("repo_id", "src", "dst", "ord"))
    reach = keep(G.reach_order(told, inner))
    listed = keep(PL.split_overflow(PL.split_groups(told), budget["max_sections"]))
    own = PL.depths(listed.filter("group_kind IS NULL AND NOT is_overflow"), budget["max_full"], budget["max_major"])
    roots = own.filter("is_entry AND n_importers = 0").select("repo_id", "path")
    own = own.join(imports_of(roots, inner).withColumn("in_shell", F.lit(True)), ["repo_id", "path"], "left")
    own = own.join(roots.select("repo_id").distinct().withColumn("has_roots", F.lit(True)), "repo_id", "left")
    host = F.col("is_host") & F.col("has_roots").isNotNull()
    tier = F.when(host, "entry").when(F.col("is_foundation"), "core").when((F.col("category") == "component") & F.col("in_shell"), "route").otherwise(F.col("category"))
    own = keep(own.withColumn("tier_kind", tier).drop("in_shell", "has_roots"))
    # state of one or two screens follows the first of them
    states = own.filter("category IN ('core', 'helper') AND NOT is_foundation AND NOT is_entry AND NOT is_list")
    pairs = keep(K.paired_screens(states, own.filter("tier_kind = 'component'"), inner, rare, reach))
    paired = own.select("repo_id", "path", "seq", "depth").join(pairs, ["repo_id", "path"])
    alone = own.join(pairs.select("repo_id", "path"), ["repo_id", "path"], "left_anti")
    placed = PL.tier_order(alone.join(reach, ["repo_id", "path"], "left"))
    folded = PL.fold_folders(placed.withColumn("tier", PL.tier_of(F.col("tier_kind")).cast("double")))
    file_id = F.concat(F.lit("file:"), "path")
    depth = own.select("repo_id", file_id.alias("section_id"), "depth")
    none = F.lit(None).cast("string")
    folded = folded.join(depth, ["repo_id", "section_id"], "left").select("repo_id", "tier", "ord", "section_id", "kind", "depth", "paths", F.lit(False).alias("is_overflow"), none.alias("group_kind"))
    late, group = F.lit(10_000), F.lit("group").alias("kind")
    groups = PL.group_sections(listed).select("repo_id", "tier", late.alias("ord"), "section_id", group, none.alias("depth"), "paths", F.lit(False).alias("is_overflow"), F.substring_index("section_id", ":", -1).alias("group_kind"))
    more = PL.overflow_sections(listed.filter("is_overflow")).filter("section_id IS NOT NULL")
    more = more.select("repo_id", F.col("tier").cast("double").alias("tier"), late.alias("ord"), "section_id", group, none.alias("depth"), "paths", F.lit(True).alias("is_overflow"), none.alias("group_kind"))
    order = Window.partitionBy("repo_id").orderBy("tier", "ord", "section_id")
    sections = folded.unionByName(groups).unionByName(more).withColumn("ord", F.row_number().over(order))
    sections = keep(PL.drop_excess(sections, budget["max_sections"]).withColumn("chapter", PL.chapter_of(F.col("tier"))))
    # screens: what routes and entries import
    screens = keep(imports_of(own.filter("tier_kind = 'route' OR is_entry"), inner))
    ordered = with_siblings(sections, rare, screens)
    anchors = sections.select("repo_id", F.explode("paths").alias("screen"), F.col("section_id").alias("after"))
    after = paired.join(anchors, ["repo_id", "screen"], "left").select("repo_id", file_id.alias("section_id"), "after", F.col("seq").cast("int").alias("ord"))
    ordered = PL.place_pairs(keep(ordered), keep(after))
    facts = sections.select("repo_id", "section_id", "kind", "depth", "paths", "group_kind").unionByName(
        paired.select("repo_id", file_id.alias("section_id"), F.lit("file").alias("kind"), "depth", F.array("path").alias("paths"), none.alias("group_kind"))
    )
    shaped = keep(PL.shape_chapters(ordered.join(facts, ["repo_id", "section_id"])))
    marked = shaped.join(_screen_ids(screens), ["repo_id", "section_id"], "left").withColumn("is_screen", F.coalesce("is_screen", F.lit(False)))
    cut = PL.split_long_chapters(marked).select("repo_id", "section_id", F.col("chapter").alias("run"))
    out = shaped.join(cut, ["repo_id", "section_id"]).withColumn("chapter", F.col("run")).withColumn("chapter_title", PL.split_title(F.col("run"), F.col("chapter_title")))
    return PL.unique_ids(out).select("repo_id", F.col("ord").cast("int").alias("ord"), "section_id", "kind", "chapter", "chapter_title", "depth", "paths")


def _screen_ids(screens: DataFrame) -> DataFrame:
    return screens.select("repo_id", F.concat(F.lit("file:"), "path").alias("section_id"), F.lit(True).alias("is_screen"))


def with_siblings(sections: DataFrame, rare: DataFrame, screens: DataFrame) -> DataFrame:
    """(repo_id, section_id, chapter, ord) after similar screens moved together: those of one chapter that share three rare
    names, and half of those of the one with fewer. rare: repo_id, name, path; screens: repo_id, path."""
    marked = sections.select("repo_id", "section_id", "chapter", F.col("ord").cast("int").alias("ord")).join(_screen_ids(screens), ["repo_id", "section_id"], "left").withColumn("is_screen", F.coalesce("is_screen", F.lit(False)))
    names = rare.join(screens, ["repo_id", "path"], "left_semi").select("repo_id", F.concat(F.lit("file:"), "path").alias("section_id"), "name").distinct()
    n = names.groupBy("repo_id", "section_id").agg(F.count(F.lit(1)).alias("n"))
    other = names.select("repo_id", "name", F.col("section_id").alias("other"))
    shared = names.join(other, ["repo_id", "name"]).filter("section_id > other").groupBy("repo_id", "section_id", "other").agg(F.count(F.lit(1)).alias("shared"))
    sized = shared.join(n, ["repo_id", "section_id"]).join(n.select("repo_id", F.col("section_id").alias("other"), F.col("n").alias("m")), ["repo_id", "other"])
    return PL.move_siblings(marked, sized.filter((F.col("shared") >= 3) & (F.col("shared") >= 0.5 * F.least("n", "m"))))


def narration_input(sections: DataFrame, files: DataFrame, length: str = "medium", edges: DataFrame | None = None) -> DataFrame:
    """Sections with chunks of source and word targets, ready for narrate: run_key, section_id, ord, kind, label,
    chunks, lo, hi. With edges the last chunk is followed by related code from other files (T7, N14)."""
    budget = C.BUDGETS[length]
    content = files.select("repo_id", "path", "content", "lines")
    first = sections.select("repo_id", "section_id", "ord", "kind", "depth", "paths", F.posexplode(F.slice("paths", 1, PL.MAX_SHOWN)).alias("pos", "path")).join(content, ["repo_id", "path"])
    share = F.greatest(F.lit(700), F.floor(F.lit(budget["group_chars"]) / F.size("paths"))).cast("int")
    alone = PL.chunked(first.filter("kind = 'file'"), budget["chunk_chars"]).filter("depth <> 'brief' OR chunk.index = 0")
    alone = alone.groupBy("repo_id", "section_id", "ord", "depth", "lines").agg(F.array_sort(F.collect_list(F.struct("chunk.index", "chunk.text"))).alias("c"), F.first("path").alias("label"))
    bounds = lambda i: F.when(F.col("depth") == "major", budget["major"][i]).when(F.col("depth") == "full", budget["full"][i]).otherwise(budget["brief"][i])
    alone = alone.withColumn("t", PL.word_target(bounds(0), bounds(1), F.col("lines"))).select("repo_id", "section_id", "ord", F.lit("file").alias("kind"), "label", F.col("c.text").alias("chunks"), "t.lo", "t.hi")
    grouped = first.filter("kind = 'group'").groupBy("repo_id", "section_id", "ord").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("path", F.lit("\n"), F.substring(F.col("content"), F.lit(1), share)).alias("text")))).alias("c"), F.first("paths").alias("paths"))
    grouped = grouped.select("repo_id", "section_id", "ord", F.lit("group").alias("kind"), PL.section_label(F.col("section_id"), F.col("paths")).alias("label"), F.array(F.array_join("c.text", "\n\n")).alias("chunks"), F.lit(budget["group"][0]).alias("lo"), F.lit(budget["group"][1]).alias("hi"))
    out = alone.unionByName(grouped)
    if edges is not None:
        code = files.select("repo_id", "path", "category", "content")
        rare, inner = G.checkpointed(rare_names_of(code)), G.kept_edges(edges, code).select("repo_id", "src", "dst")
        of_file = RL.related_excerpts(code, rare, inner, total=budget["related_chars"]).withColumn("section_id", F.concat(F.lit("file:"), "path"))
        of_group = RL.group_excerpts(sections.filter("kind = 'group'").select("repo_id", "section_id", "paths"), code, rare, inner, budget["related_chars"])
        columns = ["repo_id", "section_id", "ord", "other", "why", "text"]
        found = of_file.select(*columns).unionByName(of_group.select(*columns))
        said = F.concat("other", F.lit(" ("), "why", F.lit("):\n"), "text")
        listed = found.groupBy("repo_id", "section_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("i"), said.alias("s")))).alias("r")).select("repo_id", "section_id", F.array_join("r.s", "\n\n").alias("related"))
        out = out.join(G.checkpointed(listed), ["repo_id", "section_id"], "left")
        n = F.size("chunks")
        more = F.transform("chunks", lambda c, i: F.when((i == n - 1) & F.col("related").isNotNull(), F.concat(c, F.lit("\n\nRelated code:\n"), "related")).otherwise(c))
        out = out.withColumn("chunks", more).drop("related")
    return out.withColumnRenamed("repo_id", "run_key")


def tour_facts(files: DataFrame, readmes: DataFrame) -> DataFrame:
    """(run_key, facts): languages and dependencies, the terms to explain once, tests, and the README's opening."""
    deps = G.checkpointed(ST.manifest_dependencies(files))
    terms = ST.core_terms(files, deps).groupBy("repo_id").agg(F.array_sort(F.collect_list(F.struct("ord", "term"))).alias("t"))
    opening = files.join(readmes.select("repo_id", F.col("readme_path").alias("path")), ["repo_id", "path"]).select("repo_id", F.concat(F.lit("README:\n"), ST.clean_readme(F.col("content"))).alias("readme"))
    both = ST.stack_lines(files, deps).join(terms, "repo_id", "left").join(ST.tests_fact(files), "repo_id", "left").join(opening, "repo_id", "left")
    listed = F.when(F.size("t") > 0, F.concat(F.lit("Terms to explain once: "), F.array_join("t.term", ", "), F.lit(".")))
    return both.select(F.col("repo_id").alias("run_key"), F.concat_ws("\n", F.when(F.col("stack") != "", F.col("stack")), listed, "fact", "readme").alias("facts"))


def tree_outline(files: DataFrame, most: int = 180) -> DataFrame:
    """(repo_id, line, text): an indented outline, folders before files, both in natural order; a folder that holds only
    one folder shares its line. Beyond most lines a last one counts the files that are not shown.

    Every node, folder or file, is a row that knows its ancestors; which of these share a line is one aggregation."""
    segments = P.segments(F.col("path"))
    heads = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/"))
    nodes = files.select("repo_id", F.posexplode(heads).alias("i", "node"), (F.size(segments) - 1).alias("last"))
    nodes = nodes.groupBy("repo_id", "node").agg(F.max((F.col("i") < F.col("last")).cast("int")).alias("is_dir"))
    parent = P.dirname(F.col("node"))
    chained = nodes.filter(parent != "").groupBy("repo_id", parent.alias("above")).agg(F.count(F.lit(1)).alias("n"), F.min("is_dir").alias("dirs")).filter("n = 1 AND dirs = 1").select("repo_id", "above")
    own = P.segments(F.col("node"))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda n: F.array_join(F.slice(own, F.lit(1), n), "/"))
    listed = nodes.join(chained.withColumnRenamed("above", "node").withColumn("shares", F.lit(True)), ["repo_id", "node"], "left").filter("shares IS NULL").drop("shares")
    ancestors = listed.filter(F.size(own) > 1).select("repo_id", "node", F.posexplode(above).alias("i", "above"))
    shared = ancestors.join(chained.withColumn("shares", F.lit(1)), ["repo_id", "above"], "left")
    # the line's name starts after the last ancestor that has a line of its own
    facts = shared.groupBy("repo_id", "node").agg(F.sum(F.when(F.col("shares").isNull(), 1).otherwise(0)).alias("depth"), F.max(F.when(F.col("shares").isNull(), F.length("above") + 1)).alias("skip"))
    whole = listed.join(facts, ["repo_id", "node"], "left").na.fill(0, ["depth", "skip"])
    key = F.transform(own, lambda x, i: F.struct(((i == F.size(own) - 1) & (F.col("is_dir") == 0)).cast("int").alias("file"), PL.natural_key(x).alias("key"), x.alias("name")))
    ordered = whole.withColumn("line", F.row_number().over(Window.partitionBy("repo_id").orderBy(key)))
    name = F.expr("concat(repeat('  ', cast(depth as int)), substring(node, cast(skip as int) + 1), if(is_dir = 1, '/', ''))")
    shown = ordered.filter(F.col("line") <= most).select("repo_id", "line", name.alias("text"))
    hidden = ordered.filter((F.col("line") > most) & (F.col("is_dir") == 0)).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n"))
    return shown.unionByName(hidden.select("repo_id", F.lit(most + 1).alias("line"), F.concat(F.lit("(and "), F.col("n").cast("string"), F.lit(" more files)")).alias("text")))


def open_folders(files: DataFrame, small: int = 60, large: int = 250) -> DataFrame:
    """(repo_id, dir): folders that are open at first: all of a small repository, the upper two levels or the first of
    larger ones. files: repo_id, path."""
    total = files.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"))
    segments = P.segments(F.col("path"))
    heads = F.when(F.size(segments) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda n: F.array_join(F.slice(segments, F.lit(1), n), "/")))
    dirs = files.select("repo_id", F.explode(heads).alias("dir")).distinct().join(total, "repo_id")
    levels = F.when(F.col("total") <= small, F.lit(2**31 - 1)).when(F.col("total") <= large, 2).otherwise(1)
    return dirs.filter(F.size(F.split("dir", "/")) <= levels).select("repo_id", "dir")
