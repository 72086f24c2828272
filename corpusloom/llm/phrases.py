"""Phrase collocations: n-grams exploded into rows, hash-aggregated per language, scored by their parts, window-ranked.

Level by level, for n = 1 up to max_n, texts are cut into pieces and words, and every run of n words of a piece becomes a
row (lang, phrase, count), counted within a part of 2 MB of text first; Spark's aggregation by (lang, phrase) adds them up. A phrase is no more frequent than any part of it, so runs whose two parts of n - 1 words are not both
frequent need no row: a bit table of fixed size, in which the frequent phrases of the level before set a bit each, tells
most of them. A bit set by another phrase lets a row through in vain and changes no count; the table's size does not
depend on the corpus, its use fades as it fills, and the results stay the same. Phrases are told apart by their words
themselves, never by hashes.

A candidate is joined with the counts of its parts at each cut, and scored in Decimal. Candidates that stand nearly always
within a longer phrase go by an anti-join with the extensions of one word: a longer phrase that is frequent enough holds
one of them that is. Ranks come from two windows: within a share of a language first, then over what these leave, so no
task sorts a whole language.

Defined results: a null text counts as empty, a null lang as `und`; repeated rows count each time; a piece of any length
is read whole, long texts in parts that overlap by n - 1 words; ties go to the phrase that comes first in UTF-8 byte
order, which makes ranks unique; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.textgrams import LOWER, ngrams, text_bytes, text_parts, words_of

MAX_N, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: The bit table of the frequent phrases of a level has 2 ** FILTER_BITS bits: 4 MB.
FILTER_BITS = 25
#: Shares of a language that are ranked apart first.
SHARES = 64
SPACE, BREAK = np.zeros(256, bool), np.zeros(256, bool)
SPACE[[0x20, 0x09]] = True
BREAK[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = True
GAP = SPACE | BREAK


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, and of each word its number among them, the number of its piece and of its text."""
    data = LOWER[data]
    solid = ~GAP[data]
    begins, ends = solid.copy(), solid.copy()
    if len(data):
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] |= solid[edges]
        ends[edges - 1] |= solid[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    of_text = np.searchsorted(offsets, starts, side="right") - 1
    piece = np.cumsum(BREAK[data], dtype=np.int64)[starts] + of_text if len(starts) else starts
    buffer = pa.py_buffer(data[solid].tobytes())
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=at[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(at.tobytes()), buffer).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), piece, of_text


def _names(lang: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The languages of a batch, each row's number among them, and a value for each that enters the bit positions."""
    coded = lang.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    salt = np.array([np.uint64(int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little") * 0x9E3779B97F4A7C15 % (1 << 64)) for name in names], np.uint64)
    return names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), salt


def _positions(h: np.ndarray, salt: np.ndarray, bits: int) -> np.ndarray:
    return ((h ^ salt) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key its first place, and the number of each key among them."""
    _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return first, inverse


def _explode(n: int, shared, size: int):
    """Rows (text, lang) in, (lang, phrase, c) out: the runs of n words of a part, each counted within the part. At n = 1 a row
    without a phrase counts all words. shared: the 2 ** size bits of the level before."""

    def part(names, salt, of_row, data, offsets, first, bits) -> Iterator[pa.RecordBatch]:
        words, ids, piece, of_text = runs(data, offsets)
        if not len(ids):
            return
        lang = of_row[first + of_text]
        if n == 1:
            total = np.bincount(lang, minlength=len(names))
            yield _batch([names[k] for k in np.flatnonzero(total)], pa.nulls(int((total > 0).sum()), pa.string()), total[total > 0])
        if len(ids) < n:
            return
        at = np.flatnonzero(piece[: len(piece) - n + 1] == piece[n - 1 :])
        if n > 1:
            own = words_of(words).hashes[ids]  # a distinct word is a text of one word
            place = _positions(ngrams(own, n - 1), salt[lang[: len(lang) - n + 2]], size)
            known = (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).view(bool)
            at = at[known[at] & known[at + 1]]
        if not len(at):
            return
        # numbers of distinct prefixes, one word longer each time: exact, and below 2 ** 63
        key, wide = lang[at], max(1, len(words))
        for k in range(n):
            where, key = _distinct(key * wide + ids[at + k])
        counts, at = np.bincount(key), at[where]
        phrase = words.take(pa.array(ids[at]))
        if n > 1:
            phrase = pc.binary_join_element_wise(phrase, *[words.take(pa.array(ids[at + k])) for k in range(1, n)], pa.scalar(" ", phrase.type))
        yield _batch(pa.array(names).take(pa.array(lang[at])), phrase.cast(pa.string()), counts)

    def _batch(lang, phrase, c):
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), phrase, pa.array(c, pa.int64())], names=["lang", "phrase", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else shared.value
        for batch in batches:
            names, of_row, salt = _names(batch.column(1))
            data, offsets = text_bytes(batch.column(0))
            for some, local, first in text_parts(data, offsets, GAP, n):
                yield from part(names, salt, of_row, some, local, first, bits)

    return run


def _mark(n: int, size: int):
    """Frequent phrases (phrase, lang) of n words in, their bits out: (block, bits), 64 bits a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            _, of_row, salt = _names(batch.column(1))
            found = words_of(batch.column(0))
            place = np.unique(_positions(ngrams(found.hashes, n)[found.first[:-1]], salt[of_row], size))
            block, bit = place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))
            edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(block[edges].astype(np.int64)), pa.array(np.bitwise_or.reduceat(bit, edges).view(np.int64))], names=["block", "bits"])

    return run


def _bit_table(frequent: DataFrame, n: int, size: int):
    """The broadcast bit table of a level's frequent phrases; at most 2 ** (size - 6) rows come to the driver."""
    marks = frequent.select("phrase", "lang").mapInArrow(_mark(n, size), "block long, bits long")
    marks = marks.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    blocks = np.zeros(1 << (size - 6), np.uint64)
    if marks.num_rows:
        blocks[marks.column("block").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast(blocks.astype("<u8").view(np.uint8))


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    some = rows.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= top)
    return some.drop("rank", "share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)


def _first_words(phrase: str, k: Column) -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of 2 to max_n words that occur at least
    `least` times and not, in `share` percent of their places or more, within a longer one."""
    scratch = Scratch(df.sparkSession, "phrases")
    texts = df.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    if max_n < 2:
        raise ValueError("max_n is 2 at least")
    levels, bits, totals = [], None, None
    for n in range(1, max_n + 1):
        rows = texts.mapInArrow(_explode(n, bits, filter_bits), "lang string, phrase string, c long")
        # counted within parts already: tasks hold no table of all their phrases, and a phrase sends a row for each part at most
        counted = rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("c").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
        level = scratch.put(counted)
        if n == 1:
            totals = level.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
            level = level.filter("phrase IS NOT NULL")
        levels.append(level)
        if n < max_n:
            bits = _bit_table(level, n, filter_bits)
    # one table for all sizes: joins of unions would be joins of each level
    counts = levels[0].withColumn("size", F.lit(1))
    for n, level in enumerate(levels[1:], 2):
        counts = counts.unionByName(level.withColumn("size", F.lit(n)))
    counts = scratch.put(counts)
    for level in levels[1:]:
        scratch.drop(level)
    candidates = counts.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    size = F.col("size")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _first_words("phrase", F.col("k")).alias("left"), _first_words("phrase", F.col("k") - size).alias("right"))
    parts = F.array(_first_words("phrase", size - 1), _first_words("phrase", F.lit(1) - size))
    longer = candidates.filter("size > 2").select(F.col("lang").alias("of_lang"), F.explode(parts).alias("part"), F.col("a").alias("longer"))
    longer = longer.groupBy("of_lang", "part").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    inside = (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("part")) & (wide("longer") * 100 >= wide("a") * share)
    kept = scratch.put(candidates.join(longer, inside, "left_anti").select("lang", "phrase"))
    cuts = cuts.join(kept, ["lang", "phrase"], "left_semi")
    count_of = lambda part, c: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(c))
    joined = cuts.join(count_of("left", "l"), ["lang", "left"]).join(count_of("right", "r"), ["lang", "right"])
    score = F.expr("(cast(a AS decimal(20,0)) * cast(2000000 AS decimal(7,0))) div (cast(l AS decimal(20,0)) + cast(r AS decimal(20,0)))")
    scored = joined.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    ranked = _ranked(scored.select("lang", "phrase", "cut.score", "cut.l", "cut.r", "cut.a"), top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language over all texts of documents."""
    return phrases(table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM spots, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE i + k - 1 <= len(w)
),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k AS size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2 AND f >= 30),
kept AS (
  SELECT * FROM cands c WHERE NOT EXISTS (
    SELECT 1 FROM cands x WHERE x.lang = c.lang AND x.size > c.size AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.a >= 80 * c.a
  )
),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lp JOIN counts y ON y.lang = c.lang AND y.phrase = c.rp
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT r.lang, r.rank::BIGINT AS rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
