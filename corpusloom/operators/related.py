"""Related code for a file or a group: ranked links with the lines that matter, within budgets.

Links, their reasons and the lines are joins and expressions over all repositories at once. Only the choice under a budget
depends on what was chosen before; it is a fold over the ranked links of one file, never over a repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.operators import links as K
from corpusloom.operators.graph import checkpointed

SHARES, USES, USED = "shares names with this file", "uses this file", "is used by this file"
REASONS = (SHARES, USES, USED)
MAX_FILES, PER_FILE, TOTAL = 5, 1200, 5000
HOP_CHARS, MAX_HOPS, MAX_NAMED = 400, 2, 4
LOGIC = ("core", "helper")
CHOSEN = "array<struct<path:string,why:string,text:string>>"


def exports_of(files: DataFrame) -> DataFrame:
    """(repo_id, path, exports, registry) of files (repo_id, path, content)."""
    return files.select("repo_id", "path", K.exported_names(F.col("path"), F.col("content")).alias("exports"), K.is_registry(F.col("content")).alias("registry"))


def code_index(files: DataFrame, rare: DataFrame, exports: DataFrame) -> DataFrame:
    """The positional index of all that links may ask for: rare names and exports."""
    return K.positional_index(files, rare.select("repo_id", "name").union(exports.select("repo_id", F.explode("exports"))))


def related_candidates(files: DataFrame, rare: DataFrame, edges: DataFrame, exports: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """A5: (repo_id, path, other, score, names, why, shared, rank) of every link of a file: 4 over the holders for each rare
    name, 1 for a file that imports it, 1.5 for one that it imports; lists of constants count a fifth.

    names: what to look for in the other file: shared names, what the file exports to an importer, what it mentions of the
    exports of an import. shared: the rare names among these. files: repo_id, path, content. exports and index: as
    exports_of and code_index have them."""
    exports = exports_of(files) if exports is None else exports
    index = code_index(files, rare, exports) if index is None else index
    own = rare.select("repo_id", "name", "path", "holders")
    pairs = own.join(own.select("repo_id", "name", F.col("path").alias("other")), ["repo_id", "name"]).filter("path <> other")
    by_name = pairs.groupBy("repo_id", "path", "other").agg(F.sum(4.0 / F.col("holders")).alias("score"), F.collect_set("name").alias("names"))
    none = F.array().cast("array<string>")
    by_name = by_name.select("repo_id", "path", "other", "score", "names", F.lit(0).alias("why"))
    into = edges.select("repo_id", F.col("dst").alias("path"), F.col("src").alias("other")).filter("path <> other")
    uses = into.join(exports.select("repo_id", "path", "exports"), ["repo_id", "path"]).select("repo_id", "path", "other", F.lit(1.0).alias("score"), F.col("exports").alias("names"), F.lit(1).alias("why"))
    out = edges.select("repo_id", F.col("src").alias("path"), F.col("dst").alias("other")).filter("path <> other")
    known = exports.select("repo_id", F.col("path").alias("other"), F.explode("exports").alias("name"))
    mentions = out.distinct().join(known, ["repo_id", "other"]).join(index.select("repo_id", "path", "name"), ["repo_id", "path", "name"])
    mentions = mentions.groupBy("repo_id", "path", "other").agg(F.collect_set("name").alias("names"))
    used = out.join(exports.select("repo_id", F.col("path").alias("other")), ["repo_id", "other"], "left_semi").join(files.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    used = used.join(mentions, ["repo_id", "path", "other"], "left").select("repo_id", "path", "other", F.lit(1.5).alias("score"), F.coalesce("names", none).alias("names"), F.lit(2).alias("why"))
    parts = by_name.unionByName(uses).unionByName(used)
    summed = parts.groupBy("repo_id", "path", "other").agg(
        F.sum("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"),
        F.array_sort(F.collect_set("why")).alias("why"),
    )
    scored = summed.join(exports.select("repo_id", F.col("path").alias("other"), "registry"), ["repo_id", "other"])
    # names that the file holds itself also count as shared where they came by an import
    holds = own.groupBy("repo_id", "path").agg(F.collect_set("name").alias("held"))
    scored = scored.join(holds, ["repo_id", "path"], "left").withColumn("shared", F.array_sort(F.array_intersect("names", F.coalesce("held", none))))
    scored = scored.withColumn("score", F.when(F.col("registry"), F.col("score") * 0.2).otherwise(F.col("score")))
    said = F.array_join(F.transform("why", lambda k: F.get(F.array(*map(F.lit, REASONS)), k)), "; ")
    rank = F.row_number().over(Window.partitionBy("repo_id", "path").orderBy(F.desc("score"), "other"))
    return scored.withColumn("rank", rank).select("repo_id", "path", "other", "score", "names", "shared", "rank", said.alias("why"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once: a lambda's column is evaluated at each mention."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _fitted(pieces: Column, room: Column) -> Column:
    """The pieces that fit into so many characters, joined; a mark where one does not."""

    def step(acc: Column, piece: Column) -> Column:
        size = acc["size"] + F.length(piece) + 1
        return _let(size, lambda size: F.when(acc["full"] | (size > acc["room"]), F.struct(acc["room"].alias("room"), acc["size"].alias("size"), acc["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
            F.struct(acc["room"].alias("room"), size.alias("size"), (acc["n"] + 1).alias("n"), F.lit(False).alias("full"))
        ))

    zero = F.struct(room.cast("int").alias("room"), F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    rest = lambda n: F.when(n < F.size(pieces), F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))
    return _let(F.aggregate(pieces, zero, step, lambda acc: acc["n"]), lambda n: F.trim(F.array_join(F.concat(F.slice(pieces, F.lit(1), n), rest(n)), "\n")))


def related_excerpts(files: DataFrame, rare: DataFrame, edges: DataFrame, max_files: int = MAX_FILES, per_file: int = PER_FILE, total: int = TOTAL) -> DataFrame:
    """(repo_id, path, ord, other, why, text): up to max_files linked files, best first, each with the lines that
    mention the names; files without such lines take no place. A linked file of logic that is no direct import brings the
    first file that registers it (one hop, two at most). The budget of characters ends the list.

    files: repo_id, path, category, content; edges: repo_id, src, dst."""
    rare, exports = checkpointed(rare), checkpointed(exports_of(files))
    index = checkpointed(code_index(files, rare, exports))
    ranked = checkpointed(related_candidates(files, rare, edges, exports, index))
    lines = K.excerpt_pieces(files, ranked.select("repo_id", F.col("other").alias("path"), F.struct("path", "rank").alias("key"), "names"), index=index)
    named = F.when(F.size("shared") > 0, F.concat(F.lit(" ("), F.array_join(F.slice("shared", 1, MAX_NAMED), ", "), F.lit(")"))).otherwise(F.lit(""))
    found = ranked.join(lines.select("repo_id", F.col("path").alias("other"), F.col("key.path").alias("path"), "pieces"), ["repo_id", "path", "other"]).filter(F.size("pieces") > 0)
    # where a file of logic is registered: its importers in order, each with the lines that mention its exports
    logic = exports.join(files.filter(F.col("category").isin(*LOGIC)).select("repo_id", "path"), ["repo_id", "path"], "left_semi").select("repo_id", "path", F.col("exports").alias("names"))
    into = edges.select("repo_id", F.col("dst").alias("other"), F.col("src").alias("via")).filter("other <> via")
    asked = into.join(logic.withColumnRenamed("path", "other"), ["repo_id", "other"]).select("repo_id", F.col("via").alias("path"), F.col("other").alias("key"), "names")
    hops = K.excerpt_pieces(files, asked, around=1, index=index).groupBy("repo_id", F.col("key").alias("other")).agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("via"), F.col("pieces").alias("lines")))).alias("hops"))
    direct = edges.select("repo_id", F.col("src").alias("path"), F.col("dst").alias("other")).union(edges.select("repo_id", "dst", "src")).distinct().withColumn("direct", F.lit(True))
    found = found.join(hops, ["repo_id", "other"], "left").join(direct, ["repo_id", "path", "other"], "left")
    may_hop = F.when(F.col("direct").isNull(), F.col("hops"))
    row = F.struct("rank", "other", F.concat("why", named).alias("why"), "pieces", may_hop.alias("hops"))
    listed = found.groupBy("repo_id", "path").agg(F.array_sort(F.collect_list(row)).alias("links"))

    def step(acc: Column, x: Column) -> Column:
        open_ = (acc["files"] < max_files) & (acc["used"] < total)
        text = F.when(open_, _fitted(x["pieces"], F.least(F.lit(per_file), F.lit(total) - acc["used"])))

        def linked(text: Column) -> Column:
            one = F.struct(x["other"].alias("path"), x["why"].alias("why"), text.alias("text"))
            after = F.struct(
                acc["self"].alias("self"), (acc["used"] + F.length(text)).alias("used"), (acc["files"] + 1).alias("files"), acc["hops"].alias("hops"), F.array_append(acc["out"], one).alias("out")
            )
            return F.when(F.coalesce(text != "", F.lit(False)), _let(after, hopped)).otherwise(acc)

        def hopped(now: Column) -> Column:
            via = F.get(F.filter(x["hops"], lambda h: (h["via"] != now["self"]) & ~F.exists(now["out"], lambda o: o["path"] == h["via"])), F.lit(0))
            room = F.least(F.lit(HOP_CHARS), F.lit(total) - now["used"])
            said = lambda via: F.struct(via["via"].alias("path"), F.concat(F.lit("brings in "), x["other"]).alias("why"), _fitted(via["lines"], room).alias("text"))
            more = F.when((now["hops"] < MAX_HOPS) & (now["used"] < total), _let(via, lambda v: F.when(v.isNotNull(), said(v))))
            grown = lambda m: F.struct(
                now["self"].alias("self"), (now["used"] + F.length(m["text"])).alias("used"), now["files"].alias("files"), (now["hops"] + 1).alias("hops"), F.array_append(now["out"], m).alias("out")
            )
            return _let(more, lambda m: F.when(F.coalesce(m["text"] != "", F.lit(False)), grown(m)).otherwise(now))

        return _let(text, linked)

    zero = F.struct(F.col("path").alias("self"), F.lit(0).alias("used"), F.lit(0).alias("files"), F.lit(0).alias("hops"), F.array().cast(CHOSEN).alias("out"))
    chosen = listed.select("repo_id", "path", F.posexplode(F.aggregate("links", zero, step, lambda acc: acc["out"])).alias("ord", "x"))
    return chosen.select("repo_id", "path", F.col("ord").cast("int").alias("ord"), F.col("x.path").alias("other"), "x.why", "x.text")


def group_excerpts(sections: DataFrame, files: DataFrame, rare: DataFrame, edges: DataFrame, related_chars: int, first: int = 8) -> DataFrame:
    """(repo_id, section_id, ord, other, why, text): the best two links of each of a group's first files, without files of
    the group or any named before, within seven tenths of the budget. sections: repo_id, section_id, paths."""
    links = related_excerpts(files, rare, edges, 2, 500, 900)
    heads = sections.select("repo_id", "section_id", "paths", F.posexplode(F.slice("paths", 1, first)).alias("place", "path"))
    rows = heads.join(links, ["repo_id", "path"]).filter(~F.array_contains("paths", F.col("other")))
    listed = rows.groupBy("repo_id", "section_id").agg(F.array_sort(F.collect_list(F.struct("place", "ord", F.col("other").alias("path"), "why", "text"))).alias("links"))

    def step(acc: Column, x: Column) -> Column:
        good = ~F.exists(acc["out"], lambda o: o["path"] == x["path"]) & (acc["used"] + F.length(x["text"]) <= related_chars * 0.7)
        one = F.struct(x["path"].alias("path"), x["why"].alias("why"), x["text"].alias("text"))
        return F.struct((acc["used"] + F.when(good, F.length(x["text"])).otherwise(0)).alias("used"), F.when(good, F.array_append(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("used"), F.array().cast(CHOSEN).alias("out"))
    chosen = listed.select("repo_id", "section_id", F.posexplode(F.aggregate("links", zero, step, lambda acc: acc["out"])).alias("ord", "x"))
    return chosen.select("repo_id", "section_id", F.col("ord").cast("int").alias("ord"), F.col("x.path").alias("other"), "x.why", "x.text")
