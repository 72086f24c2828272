"""Finished parts as a listening script and a Markdown document, with chapters, spoken numbers and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X

# --- fixed values: phrases of the script and the document -------------------------------------------------------
LAST_STOP = "Last stop. Where to go when you want to change something."


def chapter_runs(parts: DataFrame) -> DataFrame:
    """Adds run (number of the chapter's run), first_of_run and run_size. parts: conv, ord, chapter."""
    order = Window.partitionBy("conv").orderBy("ord")
    new = ~F.col("chapter").eqNullSafe(F.lag("chapter").over(order)) | F.lag("ord").over(order).isNull()
    runs = parts.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order).cast("int")).withColumn("first_of_run", F.col("new") == 1).drop("new")
    return runs.withColumn("run_size", F.count(F.lit(1)).over(Window.partitionBy("conv", "run")))


def _joined(pieces: Column, by: str) -> Column:
    return F.array_join(F.filter(pieces, lambda p: p.isNotNull() & (p != "")), by)


def listening_script(parts: DataFrame, tours: DataFrame) -> DataFrame:
    """(conv, script). parts: conv, ord, chapter, chapter_title, bridge, title, body; tours: conv, name, overview, closing."""
    runs = chapter_runs(parts).withColumn("number", F.row_number().over(Window.partitionBy("conv").orderBy("ord")))
    titled = F.coalesce("chapter_title", F.lit("")) != ""
    any_titled = F.max(titled.cast("int")).over(Window.partitionBy("conv")) == 1
    say = lambda label, n, title: F.concat(F.lit(label), X.number_words(n), F.lit(". "), X.end_sentence(title))
    piece = F.array(
        F.when(F.col("first_of_run") & titled & any_titled, say("Chapter ", F.col("run"), F.col("chapter_title"))),
        F.when(F.col("first_of_run") & any_titled, F.trim(F.coalesce("bridge", F.lit("")))),
        F.when(~(any_titled & (F.col("run_size") == 1)), say("Part ", F.col("number"), F.col("title"))),
        F.trim("body"),
    )
    bodies = runs.withColumn("piece", _joined(piece, "\n\n")).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    whole = bodies.join(tours, "conv")
    closing = F.trim(F.coalesce("closing", F.lit("")))
    pieces = F.concat(
        F.array(X.end_sentence(F.concat(F.lit("A guided tour of "), "name")), F.trim("overview")),
        F.col("p.piece"),
        F.array(F.when(closing != "", F.lit(LAST_STOP)), closing),
    )
    return whole.select("conv", F.concat(_joined(pieces, "\n\n"), F.lit("\n")).alias("script"))


def markdown(parts: DataFrame, tours: DataFrame) -> DataFrame:
    """(conv, markdown). parts also have paths (array); tours also title, link, model, created_at, missing (array of labels)."""
    runs = chapter_runs(parts).withColumn("number", F.row_number().over(Window.partitionBy("conv").orderBy("ord")))
    titled = F.coalesce("chapter_title", F.lit("")) != ""
    any_titled = F.max(titled.cast("int")).over(Window.partitionBy("conv")) == 1
    code = F.transform(F.slice("paths", 1, 8), lambda p: F.concat(F.lit("`"), p, F.lit("`")))
    shown = F.when(F.size("paths") > 8, F.array_append(code, F.concat(F.lit("and "), (F.size("paths") - 8).cast("string"), F.lit(" more")))).otherwise(code)
    piece = F.array(
        F.when(F.col("first_of_run") & titled & any_titled, F.concat(F.lit("## Chapter "), F.col("run").cast("string"), F.lit(": "), "chapter_title")),
        F.when(F.col("first_of_run") & any_titled & (F.trim(F.coalesce("bridge", F.lit(""))) != ""), F.concat(F.lit("*"), F.trim("bridge"), F.lit("*"))),
        F.concat(F.when(any_titled, F.lit("### ")).otherwise(F.lit("## ")), F.col("number").cast("string"), F.lit(". "), "title"),
        F.array_join(shown, " · "),
        F.trim("body"),
    )
    bodies = runs.withColumn("piece", _joined(piece, "\n\n")).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("ord", "piece"))).alias("p"))
    whole = bodies.join(tours, "conv")
    closing = F.trim(F.coalesce("closing", F.lit("")))
    pieces = F.concat(
        F.array(
            F.concat(F.lit("# "), "title"),
            F.concat(F.lit("*A spoken walkthrough of "), "link", F.lit(", written with `"), "model", F.lit("` on "), F.date_format("created_at", "MMMM d, yyyy"), F.lit(".*")),
            F.lit("## The big picture"),
            F.trim("overview"),
        ),
        F.col("p.piece"),
        F.array(
            F.when(closing != "", F.concat(F.lit("## Where to make changes\n\n"), closing)),
            F.when(F.size("missing") > 0, F.concat(F.lit("---\n\n*Not included because they couldn't be generated: "), F.array_join("missing", ", "), F.lit(".*"))),
        ),
    )
    return whole.select("conv", F.concat(_joined(pieces, "\n\n"), F.lit("\n")).alias("markdown"))


def neighbours(parts: DataFrame) -> DataFrame:
    """(conv, ord, before, next_one, next_two): labels around each part."""
    order = Window.partitionBy("conv").orderBy("ord")
    return parts.select("conv", "ord", F.lag("label").over(order).alias("before"), F.lead("label", 1).over(order).alias("next_one"), F.lead("label", 2).over(order).alias("next_two"))


def ledger_lines(notes: DataFrame) -> DataFrame:
    """(conv, key, part, line): notes (conv, part, ord, line) folded by their words; the first part's wording stays."""
    key = F.trim(F.regexp_replace(F.lower("line"), r"[^a-z0-9]+", " "))
    return notes.withColumn("key", key).filter("key <> ''").groupBy("conv", "key").agg(F.min(F.struct("part", "ord", "line")).alias("m")).select("conv", "key", "m.part", "m.line")


def terms_seen(terms: DataFrame, most: int = 40) -> DataFrame:
    """(conv, part, known): how many distinct terms (conv, part, term) earlier parts explained, at most forty."""
    first = terms.groupBy("conv", "term").agg(F.min("part").alias("part")).groupBy("conv", "part").agg(F.count(F.lit(1)).alias("new"))
    parts = terms.select("conv", "part").distinct().join(first, ["conv", "part"], "left")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv", "part", F.least(F.lit(most), F.coalesce(F.sum("new").over(before), F.lit(0))).alias("known"))


def disambiguate(names: DataFrame) -> DataFrame:
    """Adds spoken: names of a conversation that differ by case at most get their folder."""
    same = F.count(F.lit(1)).over(Window.partitionBy("conv", F.lower("name")))
    return names.withColumn("spoken", F.when((same > 1) & (F.col("folder") != ""), F.concat("name", F.lit(", in the "), "folder", F.lit(" folder"))).otherwise(F.col("name")))


def failure_runs(events: DataFrame, least: int = 3) -> DataFrame:
    """(run_id, seq): events (run_id, seq, ok) that complete a third failure in a row."""
    order = Window.partitionBy("run_id").orderBy("seq")
    streak = F.sum(F.col("ok").cast("int")).over(order)
    runs = events.withColumn("streak", streak).filter("NOT ok").withColumn("n", F.row_number().over(Window.partitionBy("run_id", "streak").orderBy("seq")))
    return runs.filter(F.col("n") == least).select("run_id", "seq")
