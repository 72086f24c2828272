"""Substring dedup by seed and extend: repeated runs of WINDOW words are removed where they do not start first.

Seeds are winnowed anchors: in each window of words the ANCHOR-word gram of least hash, the leftmost among equals. The
choice depends on the window's words alone, so equal windows have equal anchors at equal offsets, and windows whose
anchor occurs once in the corpus are unique without a look. Anchors are about an eighth as many as windows.

1. Anchors of all texts are counted by hash; those that occur once are dropped by a join with the counts of the others.
2. Texts with repeated anchors extend them: each occurrence owns the windows whose anchor it is, which reach up to
   WINDOW - ANCHOR words to either side. Within a slice of texts, windows that occur earlier in the slice repeat; only the
   hashes of the others travel, so a line that stands in every text sends one row per slice. The windows of an anchor
   that occurs often go to several groups, dealt by window hash.
3. Occurrences in a group, in order of document and position, are compared: a window whose hash came earlier repeats.
4. Back in its document, overlapping repeated windows merge to maximal repeats, and their words go.

Both joins with the texts share one exchange. Anchors and counts go to the shared folder and are dropped once used.

Defined results: a null text has no words; texts with fewer than WINDOW words lose nothing; rows with a null id neither
lose words nor count for others; rows of equal id and equal text count as one document, so they keep the same words; rows
of equal id and other texts are documents of their own, in the order of a text hash; an empty table gives an empty table;
columns named like the added ones are replaced. Hashes have 64 bits: two different windows that agree in window hash
would be taken as equal.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, table, without
from corpusloom.llm.textgrams import Words, mix, ngrams, slices, words_of

WINDOW, ANCHOR = 20, 6
#: Occurrences of an anchor for each of the groups that its windows are dealt to.
HOT_ROWS = 1000


def canonical_anchors(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window inside one text: its first word, its anchor's first word, and the anchors' hashes by word."""
    n = len(words.hashes)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = ngrams(words.hashes, anchor)
    span = window - anchor + 1
    # sliding minimum by doubling; of equal values the left one stays
    low, at, size = grams[: len(grams)], np.arange(len(grams)), 1
    while size < span:
        step = min(size, span - size)
        take = low[step:] < low[: len(low) - step]
        at = np.where(take, at[step:], at[: len(at) - step])
        low = np.where(take, low[step:], low[: len(low) - step])
        size += step
    starts = np.arange(n - window + 1)
    counts = words.counts
    room = np.repeat(words.first[1:], counts)[: n - window + 1] - starts
    inside = room >= window
    return starts[inside], at[: n - window + 1][inside], grams


def _documents(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.first) - 1), words.counts)


def _emit_anchors(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            words = words_of(batch.column(1))
            starts, at, grams = canonical_anchors(words, window, anchor)
            if not len(starts):
                continue
            at = np.unique(at)
            doc = _documents(words)[at]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), pa.array(ids[doc], pa.int64()), pa.array((at - words.first[doc]).astype(np.int32))], names=["h", "doc", "pos"])

    return run


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _later_than_first(hashes: np.ndarray, order: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each window whether an equal one comes earlier; order: the keys of a place, the most significant first."""
    rank = np.lexsort((*reversed(order), hashes))
    h = hashes[rank]
    starts = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    head = rank[np.flatnonzero(starts)[np.cumsum(starts) - 1]]  # the first place of each equal window
    later = np.zeros(len(hashes), bool)
    for key in order:
        later[rank] |= key[rank] != key[head]
    return later


def _emit_windows(window: int, anchor: int):
    """Texts with their repeated anchors (pos, groups) in; out, for each anchor and group, the windows that no earlier text of
    the slice has (fresh: their bits, windows: their hashes) and the bits of those that one has (mask)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole.filter(whole.column(3).is_valid()), 2)):
            if not batch.num_rows:
                continue
            words, spots = words_of(batch.column(2)), batch.column(3)
            starts, at, grams = canonical_anchors(words, window, anchor)
            if not len(starts):
                continue
            groups = np.zeros(len(words.hashes) + 1, np.int64)
            per_doc = np.diff(np.asarray(spots.offsets))
            pairs = spots.flatten()
            groups[pairs.field("pos").to_numpy() + np.repeat(words.first[:-1], per_doc)] = pairs.field("groups").to_numpy()
            keep = groups[at] > 0
            starts, at = starts[keep], at[keep]
            if not len(starts):
                continue
            hashes = ngrams(words.hashes, window)[starts]
            doc = _documents(words)[at]
            ids, docs = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            first = np.repeat(starts[begin], np.diff(np.r_[begin, len(at)]))  # the first window of the same anchor
            later = _later_than_first(hashes, (ids[doc], docs[doc], starts - words.first[doc]))
            # what repeats in the slice needs no group, and is dealt by its place
            spread = grams[at] + (hashes % groups[at].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key = np.where(later, mix(docs[doc].view(np.uint64) + at.astype(np.uint64)), spread)
            order = np.lexsort((starts, key, at))
            key, at, later = key[order], at[order], later[order]
            new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (key[1:] != key[:-1]) | (later[1:] != later[:-1])])
            bit = np.int64(1) << (starts[order] - first[order])
            fresh, mask = (np.bitwise_or.reduceat(np.where(x, bit, 0), new) for x in (~later, later))
            sent = np.r_[0, np.cumsum(np.add.reduceat((~later).astype(np.int64), new))]
            row = order[new]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[new].view(np.int64)), pa.array(ids[doc[row]], pa.int64()), pa.array(docs[doc[row]], pa.int64()),
                    pa.array((first[row] - words.first[doc[row]]).astype(np.int32)), pa.array(fresh), _lists(sent, hashes[order][~later].view(np.int64)), pa.array(mask),
                ],
                names=["g", "id", "doc", "start", "fresh", "windows", "mask"],
            )

    return run


def _bits(masks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each bit that is set, row by row."""
    return np.nonzero((masks[:, None] >> np.arange(min(window, 63))) & 1)


def _mark_later(window: int):
    """Occurrences sorted by group, id, document and start in; those with repeated windows out, one bit for each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, row = None, np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, ids, docs, start, fresh = (batch.column(k).to_numpy() for k in range(5))
            mask = batch.column(6).to_numpy().copy()
            # equal rows of the table count once
            keys = (g, docs, start)
            same = np.r_[row == tuple(int(k[0]) for k in keys), np.logical_and.reduce([k[1:] == k[:-1] for k in keys])]
            row = tuple(int(k[-1]) for k in keys)
            flat = batch.column(5).flatten().to_numpy()
            owner, bit = _bits(fresh, window)
            use = ~same[owner]
            flat, owner, bit = flat[use], owner[use], bit[use]
            first = np.zeros(len(flat), bool)
            # equal windows are in one group, so groups need no telling apart
            first[np.unique(flat, return_index=True)[1]] = True
            if held is not None and g[0] == held:
                first &= ~(np.isin(flat, seen) & (g[owner] == held))
            found = flat[(g[owner] == g[-1]) & first]
            seen = np.concatenate([seen, found]) if held == g[-1] else found
            held = g[-1]
            np.bitwise_or.at(mask, owner[~first], np.int64(1) << bit[~first])
            out = np.flatnonzero(mask)
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(docs[out]), pa.array(start[out]), pa.array(mask[out])], names=["doc", "start", "mask"])

    return run


def _remove(window: int, schema: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, masks = batch.column(0), batch.column(1), batch.column(2)
            n_words, removed, spans, kept = [], [], [], []
            for text, s, m in zip(texts, starts, masks, strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                n_words.append(n)
                if not s.is_valid or not len(s.values) or not n:
                    removed.append(0)
                    spans.append([])
                    kept.append(b" ".join(words))
                    continue
                at, mask = s.values.to_numpy(), m.values.to_numpy()
                row, bit = _bits(mask, window)
                begin = at[row] + bit
                begin = begin[begin + window <= n]
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                removed.append(int(gone.sum()))
                spans.append([{"first": int(a), "after": int(b)} for a, b in turns.reshape(-1, 2)])
                kept.append(b" ".join(compress(words, ~gone)))
            columns = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, SPANS), pa.array([k.decode() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *columns], names=[f.name for f in schema.fields])

    return run


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))
ADDED = "n_words long, n_removed long, removed array<struct<first:int,after:int>>, kept_text string"


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Adds n_words, n_removed, removed (maximal repeats as word ranges) and kept_text (words joined by one space)."""
    if not 0 < anchor < window or window - anchor + 1 > 60:
        raise ValueError("an anchor is shorter than the window, by at most 59 words")
    df = without(df, *[n for n in ("n_words", "n_removed", "removed", "kept_text", "repeat_starts", "repeat_masks") if n not in (text.lower(), id_col.lower())])
    scratch = Scratch(df.sparkSession, "substring-dedup")
    doc = F.xxhash64(F.col(id_col).cast("long"), F.col(text))
    texts = df.select(F.col(id_col).cast("long").alias("id"), doc.alias("doc"), F.col(text).alias("t"))
    anchors = scratch.put(texts.filter("id IS NOT NULL").select("doc", "t").mapInArrow(_emit_anchors(window, anchor), "h long, doc long, pos int"))
    counts = scratch.put(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    scratch.free()
    groups = F.ceil(F.col("n") / F.lit(HOT_ROWS)).cast("int").alias("groups")
    repeated = anchors.join(counts.hint("merge"), "h")
    spots = scratch.put(repeated.groupBy("doc").agg(F.collect_set(F.struct("pos", groups)).alias("spots")))
    scratch.drop(anchors)
    scratch.drop(counts)
    scratch.free()
    spotted = texts.join(spots.hint("merge"), "doc", "left")
    found = spotted.select("id", "doc", "t", F.when(F.col("id").isNotNull(), F.col("spots")).alias("spots"))
    found = found.mapInArrow(_emit_windows(window, anchor), "g long, id long, doc long, start int, fresh long, windows array<long>, mask long")
    later = found.repartition("g").sortWithinPartitions("g", "id", "doc", "start").mapInArrow(_mark_later(window), "doc long, start int, mask long")
    marks = later.groupBy("doc").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    marks = marks.select("doc", F.col("marks.start").alias("repeat_starts"), F.col("marks.mask").alias("repeat_masks"))
    schema = T.StructType([*df.schema.fields, *T._parse_datatype_string(ADDED).fields])
    rest = [F.col(f"`{c}`") for c in df.columns]
    if set(df.columns) == {id_col, text}:  # the same exchange serves both joins
        joined = texts.join(marks.hint("merge"), "doc", "left").select("t", "repeat_starts", "repeat_masks", *[F.col("id").cast(df.schema[c].dataType).alias(c) if c == id_col else F.col("t").alias(c) for c in df.columns])
    else:
        joined = df.join(marks.hint("merge"), doc == marks["doc"], "left").select(F.col(text).alias("t"), "repeat_starts", "repeat_masks", *rest)
    return joined.mapInArrow(_remove(window, schema), schema)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of windows that start earlier elsewhere."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
