"""Checks on the parts of a text in order: sentences against rules, openings, repeats and signposts against earlier parts.

parts: conv (what the parts belong to), part (their order), body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import text as X

# --- fixed values: sentence rules -------------------------------------------------------------------------------
RULES = {
    "screen_pointer": r"(?i)\b(listed here|this list|that line|that spot|above|below|on screen here)\b",
    "shown": r"(?i)\b(shown here|as shown|isn't shown|is shown below|you were shown|we can see here)\b",
    "spoken_dot": r"(?i)\b(?!dot\b)\w+ dot (?!env\b|com\b|org\b|io\b|net\b)\w+\b",
    "case_point": r"(?i)\b(lower ?case|upper ?case|capital letters?|capitali[sz]ed|small letters?|starts with a capital)\b",
    "hedge": r"(?i)\b(probably|likely|seems to|presumably|it appears)\b",
}
SIGNPOSTS = r"(?i)\b(the catch is|worth knowing|rough edge|one thing to watch|keep in mind|it's worth noting)\b"
BACK_REFERENCE = r"(?i)\b(already flagged|flagged (?:earlier|in the)|as (?:mentioned|flagged|we saw)|the same (?:bug|rule|steps|recipe) as|those same steps)\b"
FOLDER_OPENING = r"^The [A-Z][\w ]{0,40}?,? in the [\w ]{1,30} folder\b"


def rule_flags(parts: DataFrame) -> DataFrame:
    """(conv, part, rule, sentence) for each sentence that a rule fits."""
    each = parts.select("conv", "part", F.explode(X.sentences(F.col("body"))).alias("sentence"))
    hits = F.filter(F.array(*[F.when(F.col("sentence").rlike(p), F.lit(n)) for n, p in RULES.items()]), lambda r: r.isNotNull())
    return each.select("conv", "part", F.explode(hits).alias("rule"), "sentence")


def same_openings(parts: DataFrame, within: int = 4) -> DataFrame:
    """(conv, part, same_as): the earliest of the last four parts that opens with the same words."""
    opened = parts.select("conv", "part", X.opening(F.col("body")).alias("opening"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(-within, -1)
    seen = opened.withColumn("seen", F.collect_list(F.struct("part", "opening")).over(before))
    twins = F.filter("seen", lambda p: p["opening"] == F.col("opening"))
    return seen.filter(F.col("opening") != "").withColumn("same_as", F.try_element_at(twins, F.lit(1))["part"]).filter("same_as IS NOT NULL").select("conv", "part", "opening", "same_as")


def folder_openings(parts: DataFrame, least: int = 2) -> DataFrame:
    """(conv, part, earlier): parts that open with a folder after at least two that did."""
    fits = F.trim("body").rlike(FOLDER_OPENING)
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = parts.withColumn("fits", fits).withColumn("earlier", F.coalesce(F.sum(F.col("fits").cast("int")).over(before), F.lit(0)))
    return counted.filter((F.col("earlier") >= least) & F.col("fits")).select("conv", "part", "earlier")


def _stems(parts: DataFrame) -> DataFrame:
    each = parts.select("conv", "part", F.posexplode(X.sentences(F.col("body"))).alias("pos", "sentence"))
    return each.withColumn("stems", X.content_words(F.col("sentence"))).withColumn("n", F.size("stems"))


def repeats(parts: DataFrame, shared: int = 4, ratio: float = 0.7, near_ratio: float = 0.6, most: int = 8) -> DataFrame:
    """(conv, part, pos, sentence, twins, first_part, first_pos): sentences that repeat earlier ones, eight per part at most.

    Linked sentences share `shared` stems, so with the frequent stems of a conversation last in order, each has one of the
    shared ones among its first n - shared + 1. Sentences meet on these only; the overlap is counted on what met."""
    s = _stems(parts)
    order = Window.partitionBy("conv").orderBy("part")
    last = parts.select("conv", "part", F.lag("part").over(order).alias("last"))
    words = s.filter(F.col("n") >= shared).select("conv", "part", "pos", "n", F.explode("stems").alias("stem"))
    frequent = words.groupBy("conv", "stem").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("conv", "part", "pos").orderBy("df", "stem"))
    rare = words.join(frequent, ["conv", "stem"]).withColumn("r", rank).filter(F.col("r") <= F.col("n") - shared + 1).select("conv", "part", "pos", "stem")
    b = rare.select("conv", "stem", F.col("part").alias("part_b"), F.col("pos").alias("pos_b"))
    met = rare.join(b, ["conv", "stem"]).filter("part_b < part").select("conv", "part", "pos", "part_b", "pos_b").distinct()
    held = s.select("conv", "part", "pos", "n", "stems")
    both = met.join(held, ["conv", "part", "pos"]).join(held.select("conv", F.col("part").alias("part_b"), F.col("pos").alias("pos_b"), F.col("n").alias("n_b"), F.col("stems").alias("stems_b")), ["conv", "part_b", "pos_b"])
    pairs = both.withColumn("k", F.size(F.array_intersect("stems", "stems_b"))).drop("stems", "stems_b").join(last, ["conv", "part"])
    need = F.when(F.col("part_b") == F.col("last"), near_ratio).otherwise(ratio)
    twins = pairs.filter((F.col("k") >= shared) & (F.col("k") / F.greatest(F.lit(1), F.least("n", "n_b")) >= need))
    found = twins.groupBy("conv", "part", "pos").agg(F.array_sort(F.collect_set("part_b")).alias("twins"), F.min(F.struct("part_b", "pos_b")).alias("first"))
    ranked = found.withColumn("k", F.row_number().over(Window.partitionBy("conv", "part").orderBy("pos"))).filter(F.col("k") <= most)
    return ranked.join(s.select("conv", "part", "pos", "sentence"), ["conv", "part", "pos"]).select("conv", "part", "pos", "sentence", "twins", F.col("first.part_b").alias("first_part"), F.col("first.pos_b").alias("first_pos"))


def signposts(parts: DataFrame, least: int = 2) -> DataFrame:
    """(conv, part, phrase, used): stock phrases that earlier parts used at least twice."""
    each = parts.select("conv", "part", F.explode(F.transform(F.regexp_extract_all("body", F.lit(SIGNPOSTS), F.lit(0)), lambda m: F.lower(m))).alias("phrase"))
    counts = each.groupBy("conv", "part", "phrase").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv", "phrase").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("used") >= least).select("conv", "part", "phrase", "used")


def back_references(parts: DataFrame, shared: int = 3) -> DataFrame:
    """Sentences that refer back although no earlier sentence shares three stems with them.

    Of the stems of a sentence that refers back, the n - shared + 1 rarest of its conversation meet earlier sentences; one of
    them is shared wherever `shared` are. The overlap is counted on what met."""
    s = _stems(parts)
    refer = s.filter(F.col("sentence").rlike(BACK_REFERENCE))
    held = s.join(refer.select("conv").distinct(), "conv", "left_semi")
    each = held.select("conv", "part", "pos", F.explode("stems").alias("stem"))
    frequent = each.groupBy("conv", "stem").agg(F.count(F.lit(1)).alias("df"))
    rank = F.row_number().over(Window.partitionBy("conv", "part", "pos").orderBy("df", "stem"))
    own = refer.select("conv", "part", "pos", "n", "stems", F.explode("stems").alias("stem")).join(frequent, ["conv", "stem"]).withColumn("r", rank).filter(F.col("r") <= F.col("n") - shared + 1)
    b = each.select("conv", "stem", F.col("part").alias("part_b"), F.col("pos").alias("pos_b"))
    met = own.join(b, ["conv", "stem"]).filter("part_b < part").select("conv", "part", "pos", "stems", "part_b", "pos_b").distinct()
    both = met.join(held.select("conv", F.col("part").alias("part_b"), F.col("pos").alias("pos_b"), F.col("stems").alias("stems_b")), ["conv", "part_b", "pos_b"])
    twins = both.filter(F.size(F.array_intersect("stems", "stems_b")) >= shared).select("conv", "part", "pos").distinct()
    return refer.join(twins, ["conv", "part", "pos"], "left_anti").select("conv", "part", "pos", "sentence")


def terms_explained_again(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """(conv, part, term, sentence): the first sentence that explains a term (conv, term) the listener knows. A term begins
    with no white space.

    Sentences have postings of the words that follow an article, terms of their first word; these meet by an equi-join, and
    only what met is compared in full, so the work grows with the sentences, not with sentences times terms."""
    each = parts.select("conv", "part", F.posexplode(X.sentences(F.col("body"))).alias("pos", "sentence"))
    heads = F.transform(F.regexp_extract_all("sentence", F.lit(r"(?i)\b(?:a|an|the)(?= (\S+))"), F.lit(1)), lambda w: F.lower(w))
    # a term of one word is followed by a comma, and perhaps by an s before it
    bare = lambda w: F.regexp_replace(w, ",$", "")
    keys = F.array_distinct(F.flatten(F.transform(heads, lambda w: F.array(w, bare(w), F.regexp_replace(bare(w), "s$", "")))))
    posted = each.withColumn("head", F.explode(keys))
    known = terms.select("conv", "term").distinct().withColumn("head", F.lower(F.regexp_extract("term", r"^\S*", 0)))
    quoted = F.concat(F.lit(r"(?i)\b(?:a|an|the) \Q"), F.col("term"), F.lit(r"\Es?, (?:the|a|an|which|meaning) "))
    hit = posted.join(known, ["conv", "head"]).filter(F.regexp_like("sentence", quoted))
    return hit.groupBy("conv", "part", "term").agg(F.min_by("sentence", "pos").alias("sentence"))


def fold_flags(flags: DataFrame, most: int = 20) -> DataFrame:
    """Flags (conv, part, ord, message) without repeats, twenty per part at most, in order."""
    distinct = flags.groupBy("conv", "part", "message").agg(F.min("ord").alias("ord"))
    return distinct.withColumn("k", F.row_number().over(Window.partitionBy("conv", "part").orderBy("ord", "message"))).filter(F.col("k") <= most).drop("k")
