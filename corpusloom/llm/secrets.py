"""Secret scans in SQL functions only: fixed patterns, and sliding-window Shannon entropy per character class.

Base findings are three kinds of pattern. The method adds candidates: runs of token characters, each belonging to the
narrowest class that holds all of it (hex, base36 and base32 with separators, then base64). A window slides over a
candidate; the counts of its characters, five bits each in six whole numbers, change by one in and one out, and with them
the sum of c * log2(c), so each window costs one step of fixed size. A candidate whose highest window reaches its class's
threshold, that mixes character kinds as its class asks, that no allow-list pattern suppresses and that no base finding
covers is added.

Positions come from the pieces between matches: split() by a pattern and the matches interleave to the whole text, and a
running sum of their sizes, in blocks, places them. Texts without a possible match skip all of that after one scan.
Patterns have no repeated groups, so neither their time nor their stack grows faster than the text.

Defined results: a null text counts as empty and has no findings; every match of a very long text counts; repeated rows
give repeated results; columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table, without

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Token characters; every access key and hex run lies in such a run of at least WINDOW characters.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
WINDOW = 20
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
FOUND = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
BLOCK = 128
#: What candidates consist of; their counts lie twelve to a whole number.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
PER_LONG = 12
LONGS = -(-len(SYMBOLS) // PER_LONG)


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: all characters match `member`, the string matches every pattern of `mixes`."""

    kind: str
    member: str
    mixes: tuple[str, ...]
    bits: float


#: Letters of one case need no other kind but a digit; names whose parts are a word, a number or both in that order stay.
CLASSES = (
    CharClass("hex_entropy", r"^[0-9A-Fa-f]+$", (r"[0-9]", r"[A-Fa-f]"), 3.0),
    CharClass("base36_entropy", r"^[a-z0-9+/_-]+=*$", (r"[0-9][a-z]",), 3.2),
    CharClass("base32_entropy", r"^[A-Z0-9+/_-]+=*$", (r"[0-9][A-Z]",), 3.2),
    CharClass("base64_entropy", r"^[A-Za-z0-9+/_-]+=*$", (r"[0-9]", r"[A-Z]", r"[a-z]"), 3.6),
)
#: Candidates that are no secrets: plain words, identifiers of words and numbers, UUIDs, published example keys.
ALLOW = (
    r"^(?!.*[A-Za-z][A-Z])[A-Za-z][A-Za-z/_-]*$",
    r"^[A-Z][A-Z/_-]*$",
    r"^[A-Za-z]?[a-z]*[/_-]+[0-9]+$",
    r"^[0-9+/_-]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"EXAMPLE",
)


def _running(values: Column, combine: Callable[[Column, Column], Column], begin: int = 0) -> Column:
    """The array of running sums or maxima. Blocks of BLOCK values keep the work linear up to some million values: arrays grow
    by one element at a time only within a block and over the blocks' totals."""
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / F.lit(BLOCK)).cast("int"))
    parts = F.transform(blocks, lambda b: F.slice(values, b * F.lit(BLOCK) + 1, F.lit(BLOCK)))

    def grow(acc: Column, x: Column) -> Column:
        now = combine(acc["at"], x)
        return F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out"))

    def over(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), grow, lambda acc: acc["out"])

    totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(begin), combine))
    before = F.concat(F.array(F.lit(begin)), over(totals, F.lit(begin)))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(totals)), over))).otherwise(F.array().cast("array<int>"))


def _located(df: DataFrame, out: str, when: Column, pattern: str, ord_: int, kind: str, group: int | None = None) -> DataFrame:
    """Adds all matches as spans with their values; group: keep those whose group has at least six characters."""
    t, none = F.col("secret_text"), F.array().cast("array<string>")
    df = df.withColumn("secret_found", F.when(when, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    some = F.size("secret_found") > 0
    df = df.withColumn("secret_pieces", F.when(some, F.split(t, pattern, -1)).otherwise(none))
    # piece and match in turn: a match ends where the sizes of both add up to
    df = df.withColumn("secret_sizes", F.zip_with("secret_found", F.slice("secret_pieces", F.lit(1), F.size("secret_found")), lambda m, p: F.length(m) + F.length(p)))
    df = df.withColumn("secret_ends", _running(F.col("secret_sizes"), lambda a, x: a + x))
    values = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group else F.col("secret_found")
    zipped = F.arrays_zip(F.col("secret_found").alias("m"), F.col("secret_ends").alias("e"), F.when(some, values).otherwise(none).alias("v"))
    spans = F.transform(
        F.filter(zipped, lambda x: F.length(x["v"]) >= 6) if group else zipped,
        lambda x: F.struct((x["e"] - F.length(x["m"])).alias("start"), F.lit(ord_).alias("ord"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value")),
    )
    spans = F.when(some, spans).otherwise(F.array().cast(FOUND))
    return df.withColumn(out, spans).drop("secret_found", "secret_pieces", "secret_sizes", "secret_ends")


def window_entropy(s: Column) -> Column:
    """The highest Shannon entropy, in bits, of WINDOW consecutive characters of a string of SYMBOLS; 0 if it is shorter."""
    # a symbol's count has five bits: code >> 6 says in which whole number, code & 63 at which bit
    code_of = F.lit([(k // PER_LONG << 6) + 5 * (k % PER_LONG) for k in (max(SYMBOLS.find(chr(i)), 0) for i in range(128))])
    codes = F.transform(F.split(s, ""), lambda c: F.get(code_of, F.ascii(c)))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), codes), F.lit(1), F.length(s))
    steps = F.zip_with(codes, leaving, lambda new, old: F.struct(new.alias("new"), old.alias("old")))
    term = F.lit([0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)])
    slot, bit = lambda code: F.call_function("shiftright", code, F.lit(6)), lambda code: code.bitwiseAND(F.lit(63))
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), bit(code))
    count = lambda counts, code: F.call_function("shiftright", F.get(counts, slot(code)), bit(code)).bitwiseAND(F.lit(31)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        counts, new, old = acc["counts"], x["new"], x["old"]
        c_new, c_old = count(counts, new), F.when(old >= 0, count(counts, old))
        gained = F.get(term, c_new + 1) - F.get(term, c_new)
        lost = F.coalesce(F.get(term, c_old - 1) - F.get(term, c_old), F.lit(0.0))
        total = F.when(new == old, acc["total"]).otherwise(acc["total"] + gained + lost)
        bits = F.when(acc["i"] >= WINDOW - 1, F.lit(math.log2(WINDOW)) - total / F.lit(float(WINDOW))).otherwise(F.lit(0.0))
        none = F.lit(0).cast("long")
        moved = F.transform(counts, lambda c, k: c + F.when(k == slot(new), one(new)).otherwise(none) - F.when((old >= 0) & (k == slot(old)), one(old)).otherwise(none))
        return F.struct(moved.alias("counts"), total.alias("total"), F.greatest(acc["best"], bits).alias("best"), (acc["i"] + 1).alias("i"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"), F.lit(0).alias("i"))
    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _class_ord(s: Column, allow: tuple[str, ...]) -> Column:
    """The index of the class that finds s a secret, else null."""
    out = F.lit(None).cast("int")
    for k, c in reversed(list(enumerate(CLASSES))):
        mixed = F.lit(True)
        for pattern in c.mixes:
            mixed = mixed & s.rlike(pattern)
        out = F.when(s.rlike(c.member), F.when(mixed & (window_entropy(s) >= c.bits), F.lit(k))).otherwise(out)
    allowed = F.lit(False)
    for pattern in allow:
        allowed = allowed | s.rlike(pattern)
    return F.when(~allowed, out)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def scan_secrets(df: DataFrame, text: str = "text", allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Adds base_spans and all_spans: arrays of (start, ord, end, kind), by start, then kind."""
    helpers = ["secret_text", "secret_runs", "secret_assign", "secret_access", "secret_hex", "secret_order", "secret_reach", "secret_found", "secret_pieces", "secret_sizes", "secret_ends"]
    df = without(df, "base_spans", "all_spans", *[h for h in helpers if h != text.lower()])
    t, none = F.col("secret_text"), F.array().cast(SPAN)
    df = df.withColumn("secret_text", F.coalesce(F.col(text), F.lit("")))
    df = _located(df, "secret_runs", t.rlike(r"[A-Za-z0-9+/_-]{20}"), CANDIDATE, 0, "run")
    runs = F.size("secret_runs") > 0
    df = _located(df, "secret_assign", (F.contains(t, F.lit("=")) | F.contains(t, F.lit(":"))) & t.rlike(ASSIGN), ASSIGN, 0, "assign", 2)
    df = _located(df, "secret_access", runs & F.contains(t, F.lit("AKIA")), ACCESS, 1, "access")
    df = _located(df, "secret_hex", runs & t.rlike(HEX), HEX, 2, "hex")
    span = lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))
    df = df.withColumn("base_spans", F.array_sort(F.transform(F.concat("secret_assign", "secret_access", "secret_hex"), span)))
    # runs and base spans by start, and how far the base spans so far reach: a run beyond that is not covered
    both = runs & (F.size("base_spans") > 0)
    mixed = F.concat(
        F.transform("base_spans", lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("run"), b["end"].alias("end"), F.lit(None).cast("string").alias("value"))),
        F.transform("secret_runs", lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("run"), r["end"].alias("end"), r["value"].alias("value"))),
    )
    df = df.withColumn("secret_order", F.when(both, F.array_sort(mixed)))
    df = df.withColumn("secret_reach", F.when(both, _running(F.transform("secret_order", lambda x: F.when(x["run"] == 1, F.lit(0)).otherwise(x["end"])), lambda a, x: F.greatest(a, x))))
    open_ = F.filter(F.arrays_zip(F.col("secret_order").alias("x"), F.col("secret_reach").alias("reach")), lambda z: (z["x"]["run"] == 1) & (z["reach"] < z["x"]["end"]))
    as_run = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
    fresh = F.when(both, F.transform(open_, lambda z: as_run(z["x"]))).otherwise(F.transform("secret_runs", as_run))
    judged = F.transform(fresh, lambda r: F.struct(r["start"].alias("start"), _class_ord(r["value"], allow).alias("k"), r["end"].alias("end")))
    kinds = F.lit([c.kind for c in CLASSES])
    found = F.transform(
        F.filter(judged, lambda x: x["k"].isNotNull()),
        lambda x: F.struct(x["start"].alias("start"), (x["k"] + 3).alias("ord"), x["end"].alias("end"), F.get(kinds, x["k"]).alias("kind")),
    )
    added = F.when(runs, found).otherwise(none)
    return df.withColumn("all_spans", F.array_sort(F.concat("base_spans", added))).drop(*[h for h in helpers if h != text.lower()])


def redact(df: DataFrame, text: str = "text", spans: str = "all_spans", mark: str = "[SECRET]") -> DataFrame:
    """Replaces each span by the mark; overlapping spans become one. A null text stays null."""
    df = without(df, "redact_ends", "redact_gaps")
    some = F.size(F.col(spans)) > 0
    df = df.withColumn("redact_ends", F.when(some, _running(F.transform(F.col(spans), lambda x: x["end"]), lambda a, x: F.greatest(a, x))))
    gap = lambda a, b: F.struct(a.alias("from"), b.alias("to"))
    before = F.concat(F.array(F.lit(0)), F.slice("redact_ends", F.lit(1), F.size("redact_ends") - 1))
    gaps = F.filter(F.zip_with(before, F.transform(F.col(spans), lambda x: x["start"]), gap), lambda g: g["to"] >= g["from"])
    tail = gap(F.element_at("redact_ends", -1), F.length(F.col(text)))
    df = df.withColumn("redact_gaps", F.when(some, F.concat(gaps, F.array(tail))))
    # the kept pieces, cut from the text of BLOCK gaps at a time
    blocks = F.sequence(F.lit(0), F.floor((F.size("redact_gaps") - 1) / F.lit(BLOCK)).cast("int"))

    def pieces(b: Column) -> Column:
        own = F.slice("redact_gaps", b * F.lit(BLOCK) + 1, F.lit(BLOCK))
        first, last = F.get(own, F.lit(0))["from"], F.element_at(own, -1)["to"]
        held = F.struct(first.alias("at"), F.substring(F.col(text), first + 1, last - first).alias("s"), own.alias("own"))
        return F.flatten(F.transform(F.array(held), lambda h: F.transform(h["own"], lambda g: F.substring(h["s"], g["from"] - h["at"] + 1, g["to"] - g["from"]))))

    whole = F.array_join(F.flatten(F.transform(blocks, pieces)), mark)
    return df.withColumn(text, F.when(some, whole).otherwise(F.col(text))).drop("redact_ends", "redact_gaps")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scan_secrets(docs)
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(_text(F.col("base_spans")), 256).alias("base_sha256"),
        _text(F.col("all_spans")).alias("spans"),
    )
