"""Column functions over prose: sentences, words, spoken forms, labels. JVM-side unless the name says udf."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\s\u000B\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# --- fixed values: words without meaning of their own -----------------------------------------------------------
STOP_WORDS = (
    "a an the and or but so if then than that this these those it its it's is are was were be been being to of in on at by for with from as into "
    "when while which who whom what where why how not no nor too very can could would should will just only also there here they them their you your "
    "we our us he she his her has have had do does did done one two any each every all some more most other such same own about over under again "
    "out up down off once both few because until before after through during"
).split()
# --- fixed values: number words ---------------------------------------------------------------------------------
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ["", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split()]


def squeeze(text: Column) -> Column:
    return F.regexp_replace(text, WHITE + "+", " ")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{WHITE}+|{WHITE}+\z", "")


def sentences(text: Column, least_words: int = 4) -> Column:
    """Sentences of at least four words, with closing quotes."""
    found = F.regexp_extract_all(squeeze(text), F.lit("[^.!?]+[.!?]+[\"”')]*"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: F.size(F.split(s, " ")) >= least_words)


def first_sentences(text: Column, most: int = 2) -> Column:
    """X6."""
    flat = squeeze(text)
    found = F.regexp_extract_all(flat, F.lit(r"[^.!?]+[.!?]+"), F.lit(0))
    return F.when(F.size(found) > 0, F.array_join(F.transform(F.slice(found, 1, most), lambda s: F.trim(s)), " ")).otherwise(F.trim(text))


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and apostrophes."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9' ]+", " "), r"\s+"), lambda w: w != "")


def stem(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, r"'s$", ""), r"(ing|ed|es|s)$", "")


def content_words(text: Column) -> Column:
    """Distinct stems of the words that carry meaning."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 2)), stem))


def opening(text: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def end_sentence(text: Column) -> Column:
    """A sentence that stops: a period unless it ends in . ! or ?"""
    t = strip(text)
    return F.when(t.rlike(r"[.!?]\z"), t).otherwise(F.concat(t, F.lit(".")))


def quote(text: Column, most: int = 160) -> Column:
    return F.concat(F.lit('"'), F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("…"))).otherwise(text), F.lit('"'))


def truncate(text: Column, most: int) -> Column:
    flat = F.trim(squeeze(text))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def number_words(n: Column) -> Column:
    """0 to 999 in words, others in digits."""
    ones, tens = F.lit(ONES), F.lit(TENS)
    small = lambda x: F.when(x < 20, F.get(ones, x)).otherwise(F.concat(F.get(tens, F.floor(x / 10).cast("int")), F.when(x % 10 > 0, F.concat(F.lit("-"), F.get(ones, x % 10))).otherwise(F.lit(""))))
    x = n.cast("int")
    large = F.concat(F.get(ones, F.floor(x / 100).cast("int")), F.lit(" hundred"), F.when(x % 100 > 0, F.concat(F.lit(" and "), small(x % 100))).otherwise(F.lit("")))
    return F.when((n < 0) | (n > 999), n.cast("string")).when(x < 100, small(x)).otherwise(large)


def spoken_name(name: Column) -> Column:
    """A repository's name as a person says it."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"[-_./]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9-]+", "-"), "-+", "-")


def mask_key(key: Column) -> Column:
    """The ends of a secret."""
    return F.when(F.length(key) <= 8, F.lit("••••")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("…"), F.substring(key, -4, 4)))


def script_stats(text: Column) -> Column:
    """Words, characters, and minutes at 150 words a minute."""
    n = F.size(F.filter(F.split(text, WHITE + "+"), lambda w: w != ""))
    return F.struct(n.alias("words"), F.length(text).alias("characters"), F.greatest(F.lit(1), F.floor(n / 150.0 + 0.5).cast("int")).alias("minutes"))


def normalise_paragraphs(text: Column) -> Column:
    """One line per paragraph."""
    parts = F.transform(F.split(text, r"\n{2,}"), lambda p: strip(F.regexp_replace(p, r"\n+", " ")))
    return F.array_join(F.filter(parts, lambda p: p != ""), "\n\n")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, F.length(text)))


def strip_markup(text: Column) -> Column:
    """The steps of the spoken clean-up whose replacements are fixed: fences, comments, tags, rules, quotes, links, code marks, symbols."""
    steps = [
        ("\r\n?", "\n"),
        (r"(?s)```.*?(```|\z)", ""),
        (r"(?s)~~~.*?(~~~|\z)", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"</?[a-zA-Z][^>\n]*>", ""),
        (r"(?m)^[ \t]*>[ \t]?", ""),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"`+([^`\n]+?)`+", "$1"),
        ("`", ""),
        (r"[ \t]*(?:->|→|=>|⟶)[ \t]*", " to "),
        (r"[ \t]+&[ \t]+", " and "),
        (r"(?i)\be\.g\.,?", "for example,"),
        (r"(?i)\bi\.e\.,?", "that is,"),
    ]
    for pattern, new in steps:
        text = F.regexp_replace(text, pattern, new)
    return text
