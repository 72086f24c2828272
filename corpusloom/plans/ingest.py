"""From archive entries to analysed files: the whole ingest as one set of tables for many repositories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import paths as P
from corpusloom.operators import graph as G
from corpusloom.operators import ingest as I
from corpusloom.sources.archive import archive_errors


@dataclass
class Ingest:
    """files: repo_id, seq, path, size, content, lines, language, category, is_entry, n_imports, n_importers, importance.
    edges: repo_id, src, dst, ord. skipped: repo_id, path, reason, is_dir. readmes: repo_id, readme_path. stats: per repository.
    errors: repo_id, stage, code of the repositories that have no files here, and why."""

    files: DataFrame
    edges: DataFrame
    skipped: DataFrame
    readmes: DataFrame
    stats: DataFrame
    errors: DataFrame


def read_texts(entries: DataFrame) -> DataFrame:
    """Entries (repo_id, seq, path, size, bytes) with content and reason (null: keep), in the order in which a reader decides."""
    f = entries.withColumn("verdict", P.path_verdict(F.col("path"), F.col("size"))).withColumn("decoded", I.decode_text(F.col("bytes")))
    is_notebook = P.extension(F.col("path")) == "ipynb"
    f = f.withColumn("content", F.when(is_notebook, I.notebook_text(F.col("decoded"))).otherwise(F.col("decoded")))
    of_text = (
        F.when(F.col("decoded").isNull(), "binary").when(F.col("content").isNull(), "data").when(I.is_blank(F.col("content")), "empty")
        .when(I.looks_generated(F.col("path"), F.col("content")), "generated")
    )
    f = f.withColumn("of_text", of_text)
    kept = f.filter("verdict.reason IS NULL").withColumn("passes", F.col("of_text").isNull()).withColumn("bytes_kept", F.octet_length("content").cast("long"))
    limited = I.arrival_limit(kept.select("repo_id", "seq", "passes", F.col("bytes_kept").alias("bytes"))).select("repo_id", "seq", "over_limit")
    kept = kept.join(limited, ["repo_id", "seq"]).withColumn("reason", F.when(F.col("over_limit"), "limit").otherwise(F.col("of_text")))
    return kept.select("repo_id", "seq", "path", "size", "content", "reason")


def ingest(entries: DataFrame, max_bytes: int = I.C.MAX_TOTAL_BYTES) -> Ingest:
    """All repositories of entries (repo_id, seq, path, size, bytes, and error if read_archives made them). A repository whose
    archive could not be read to its end, or that keeps no file, is an error row and in no other table but skipped."""
    errors = None
    if "error" in entries.columns:
        errors = G.checkpointed(archive_errors(entries).distinct())
        entries = entries.filter("error IS NULL").join(errors.select("repo_id"), "repo_id", "left_anti")
    base = P.basename(F.col("path"))
    rule_files = entries.filter(base.isin(".gitignore", ".gitattributes")).withColumn("content", I.decode_text(F.col("bytes")))
    ignores = I.parse_rules(rule_files.filter(base == ".gitignore").select("repo_id", "seq", "path", "size", "content"))
    linguist = I.parse_rules(I.linguist_patterns(rule_files.filter(base == ".gitattributes").select("repo_id", "seq", "path", "size", "content")))
    rest = entries.filter(~base.isin(".gitignore", ".gitattributes"))
    texts = G.checkpointed(read_texts(rest))
    good = texts.filter("reason IS NULL").drop("reason")
    rules = ignores.withColumn("hit", F.lit("gitignored")).unionByName(linguist.withColumn("hit", F.lit("generated")))
    marked = G.checkpointed(I.marked_paths(good, rules))
    files = G.checkpointed(good.join(marked, ["repo_id", "path"], "left_anti"))
    empty = entries.select("repo_id").distinct().join(files.select("repo_id").distinct(), "repo_id", "left_anti").select("repo_id", F.lit("filter").alias("stage"), F.lit("empty").alias("code"))
    errors = empty if errors is None else errors.unionByName(empty)
    hints, aliases = G.project_hints(files), G.alias_table(files)
    hints = G.checkpointed(hints)
    edges = G.checkpointed(G.import_edges(files, G.candidate_paths(files, aliases, hints.drop("deps", "src_has_main")), G.folder_imports(files, hints)))
    analysed = files.join(hints.select("repo_id", "deps", "src_has_main"), "repo_id")
    analysed = analysed.withColumn("category", P.category(F.col("path"), F.array_contains("deps", "expo-router")))
    analysed = G.promote_scripts(analysed, edges)
    declared = G.declared_entries(files).withColumn("declared", F.lit(True))
    analysed = analysed.join(declared, ["repo_id", "path"], "left")
    entry = (F.coalesce("declared", F.lit(False)) | P.is_entry_path(F.col("path"), F.col("src_has_main"), F.col("deps"))) & ~F.col("category").isin("test", "config", "docs")
    analysed = analysed.withColumn("is_entry", entry).withColumn("category", F.when(F.col("is_entry"), "entry").otherwise(F.col("category")))
    analysed = G.degrees(analysed, edges).withColumn("lines", F.size(F.split("content", "\n", -1))).withColumn("language", P.language(F.col("path")))
    score = P.importance(F.col("path"), F.col("category"), F.col("is_entry"), F.col("lines"), F.col("n_imports"), F.col("n_importers"))
    analysed = G.checkpointed(analysed.withColumn("importance", score))
    readmes = I.readme_paths(analysed)
    sized = analysed.join(readmes, "repo_id", "left").withColumn("is_readme", F.coalesce(F.col("path") == F.col("readme_path"), F.lit(False)))
    sized = sized.withColumn("bytes", F.octet_length("content").cast("long")).withColumn("chars", F.length("content"))
    trimmed = I.greedy_trim(sized.select("repo_id", "seq", "bytes", "chars", "importance", "is_readme"), max_bytes).select("repo_id", "seq", "kept")
    judged = G.checkpointed(analysed.join(trimmed, ["repo_id", "seq"]))
    final = judged.filter("kept").select("repo_id", "seq", "path", "size", "content", "lines", "language", "category", "is_entry", "n_imports", "n_importers", "importance")
    kept_edges = G.kept_edges(edges, final)
    final = G.checkpointed(G.degrees(final.drop("n_imports", "n_importers"), kept_edges))
    line = lambda df, reason: df.select("repo_id", "path", reason.alias("reason"), F.lit(False).alias("is_dir"))
    skipped = I.skipped_paths(rest).unionByName(line(texts.filter("reason IS NOT NULL"), F.col("reason"))).unionByName(line(marked, F.col("hit"))).unionByName(line(judged.filter("NOT kept"), F.lit("limit")))
    return Ingest(final, kept_edges, skipped, readmes, I.ingest_stats(final, skipped), errors)
