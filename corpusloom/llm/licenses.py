"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates by containment.

A template is a set of distinct words. Templates are grouped by size, 2^k words at most, and for each group a text's blocks
are the windows of 2^(k+1) words that begin every 2^k words: any place where a template could stand lies within one. A
block contains a template when it has at least `percent` percent of the template's words.

The join is the one of prefix filters. A first pass over all texts counts in how many blocks each word of a template
occurs, which orders them from rare to frequent; words of no template take no part. A template that must share o of its n
words has one of its n - o + 1 rarest among them, so only these are keys of the index. A block is its sorted words of
that order, and is dropped where it has fewer than the least o of its group (length filter). Its words are keys up to the
place from which o could no longer be reached (prefix filter). Keys meet in a Spark join; a pair goes on at its first
shared key, if what the positions leave on either side can still add up to o (positional filter), and its overlap is
counted in full. Templates are a parameter of at most MOST_WORDS words, which bounds all that is
broadcast; nothing is shuffled but counts of words and the labels of what matches.

Defined results: a null text counts as empty; texts without words have no blocks; texts of any length are read whole, in
parts; repeated rows are judged each on its own; a template counts once for a document however often it matches; columns
named like the added ones are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.textgrams import LOWER, SLICE, text_bytes, text_parts

#: The phrases of the contract, and notices as their licenses print them.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Released under the MIT License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
PERCENT = 90
#: Words of all templates together, at most.
MOST_WORDS = 200_000
WORD = np.ones(256, bool)
WORD[: 0x30], WORD[0x3A:0x61], WORD[0x7B:0x80] = False, False, False
#: Bytes of no word, before letters are lower-cased.
GAP = ~WORD[LOWER]


def words_in(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in lower-cased bytes of texts."""
    solid = WORD[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= solid[edges]
    ends[edges - 1] |= solid[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def template_words(text: str) -> list[str]:
    data = LOWER[np.frombuffer(text.encode(), np.uint8)]
    return [data[a:b].tobytes().decode() for a, b in zip(*words_in(data, np.array([0, len(data)])), strict=True)]


@dataclass(frozen=True)
class Index:
    """Templates as word numbers. A word's number is its place in `vocabulary`; groups: the windows' step of each."""

    vocabulary: tuple[str, ...]
    labels: tuple[str, ...]
    sets: tuple[frozenset[int], ...]
    steps: tuple[int, ...]
    phrases: tuple[tuple[int, ...], ...]

    @classmethod
    def of(cls, templates, phrases) -> Index:
        words = [template_words(text) for _, text in templates]
        if sum(map(len, words)) > MOST_WORDS or not all(words):
            raise ValueError(f"templates of 1 to {MOST_WORDS} words in all are wanted")
        fixed = [template_words(text) for text, _ in phrases]
        vocabulary = tuple(sorted({w for ws in [*words, *fixed] for w in ws}))
        number = {w: i for i, w in enumerate(vocabulary)}
        return cls(vocabulary, tuple(label for label, _ in templates), tuple(frozenset(number[w] for w in ws) for ws in words), tuple(1 << max(2, (len(ws) - 1).bit_length()) for ws in words), tuple(tuple(number[w] for w in ws) for ws in fixed))

    def needs(self, percent: int) -> list[int]:
        """How many of a template's words a block must have."""
        return [-(-percent * len(s) // 100) for s in self.sets]


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, vocabulary: tuple[str, ...]) -> np.ndarray:
    """The number of each word in the vocabulary, or -1."""
    out = np.full(len(starts), -1, np.int64)
    sizes = ends - starts
    known: dict[int, list[tuple[bytes, int]]] = {}
    for i, w in enumerate(vocabulary):
        known.setdefault(len(w.encode()), []).append((w.encode(), i))
    for size, words in known.items():
        rows = np.flatnonzero(sizes == size)
        if not len(rows):
            continue
        # words of one size as fixed-width byte strings, found by binary search; none holds a zero byte
        held = data[starts[rows][:, None] + np.arange(size)].reshape(-1).view(f"S{size}")
        words.sort()
        keys = np.array([w for w, _ in words], f"S{size}")
        at = np.minimum(np.searchsorted(keys, held), len(keys) - 1)
        same = keys[at] == held
        out[rows[same]] = np.array([i for _, i in words])[at[same]]
    return out


@dataclass
class Texts:
    """Some texts of a batch as word numbers: those of text i are numbers[first[i]:first[i + 1]]; row is that of the first."""

    row: int
    numbers: np.ndarray
    first: np.ndarray

    @property
    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _texts(column: pa.Array, index: Index, size: int) -> Iterator[Texts]:
    """Groups of texts of `size` bytes, or one text: of a long one four bytes a word are held, and its bytes in parts."""
    data, offsets = text_bytes(column)
    held: dict[int, list[np.ndarray]] = {}  # the parts of one long text
    for part, local, row in text_parts(data, offsets, GAP, size=size):
        for other in [k for k in held if k != row]:
            yield _one(other, held.pop(other))
        low = LOWER[part]
        starts, ends = words_in(low, local)
        numbers = _numbers(low, starts, ends, index.vocabulary)
        if offsets[row + 1] - offsets[row] > size:
            held.setdefault(row, []).append(numbers)
        else:
            yield Texts(row, numbers, np.searchsorted(starts, local))
    for row, parts in held.items():
        yield _one(row, parts)


def _one(row: int, parts: list[np.ndarray]) -> Texts:
    numbers = np.concatenate(parts)
    return Texts(row, numbers, np.array([0, len(numbers)]))


def _windows(texts: Texts, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, word number, edges), distinct and sorted: window b covers a text's words from b * step on, 2 * step of
    them; a text of up to 2 * step words is one window. A window's rows lie between two edges."""
    at = np.flatnonzero(texts.numbers >= 0)
    text = texts.of[at]
    sizes = np.diff(texts.first)
    last = np.maximum(0, -(-sizes // step) - 2)
    base = np.r_[0, np.cumsum(last + 1)]
    own = (at - texts.first[text]) // step
    pairs = np.r_[base[text] + np.minimum(own, last[text]), base[text] + np.maximum(own - 1, 0)] << 20 | np.r_[texts.numbers[at], texts.numbers[at]]
    pairs = np.unique(pairs)
    window, word = pairs >> 20, pairs & ((1 << 20) - 1)
    text = np.searchsorted(base, window, side="right") - 1
    edges = np.flatnonzero(np.r_[True, window[1:] != window[:-1], True]) if len(window) else np.zeros(1, np.int64)
    return text, window - base[text], word, edges


def _count(index: Index, size: int):
    """Texts in, (word, n) out: how many blocks of a task's texts hold each word."""
    steps = sorted(set(index.steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index.vocabulary), np.int64)
        for batch in batches:
            for texts in _texts(batch.column(0), index, size):
                for step in steps:
                    counts += np.bincount(_windows(texts, step)[2], minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["word", "n"])

    return run


DOCUMENT = "id {id}, n_words long, n_base long, first_word long, last_word long, base array<int>, blocks array<struct<step:int,block:long,words:array<int>>>"


def _lists(n: int, of: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Values in the order of their texts as a list for each of n texts."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _scan(index: Index, rank: np.ndarray, needs: list[int], id_type: pa.DataType, size: int):
    """Rows (id, text) in, documents with their base places and blocks out. rank: a word's place from rare to frequent; a
    block keeps its words' ranks, sorted, if it has a key and enough words for the least demanding template of its group."""
    steps = sorted(set(index.steps))
    least = {s: min(n for n, t in zip(needs, index.steps, strict=True) if t == s) for s in steps}
    keyed = {s: np.zeros(len(rank), bool) for s in steps}
    for need, step, words in zip(needs, index.steps, index.sets, strict=True):
        keyed[step][sorted(words, key=lambda w: rank[w])[: len(words) - need + 1]] = True

    def places(texts: Texts) -> list[np.ndarray]:
        of, numbers, found = texts.of, texts.numbers, []
        for phrase in index.phrases:
            n = max(0, len(numbers) - len(phrase) + 1)
            hit = (numbers[:n] == phrase[0]) & (of[:n] == of[len(of) - n :])
            for k in range(1, len(phrase)):
                hit &= numbers[k : k + n] == phrase[k]
            found.append(np.flatnonzero(hit))
        return found

    def blocks(texts: Texts) -> pa.ListArray:
        rows, parts = [], {"step": [], "block": [], "words": []}
        for step in steps:
            text, window, word, edges = _windows(texts, step)
            sizes = np.diff(edges)
            good = np.flatnonzero((sizes >= least[step]) & (np.add.reduceat(keyed[step][word], edges[:-1]) > 0)) if len(sizes) else sizes
            for b in good.tolist():
                lo, hi = edges[b], edges[b + 1]
                rows.append(int(text[lo]))
                parts["step"].append(step)
                parts["block"].append(int(window[lo]))
                parts["words"].append(np.sort(rank[word[lo:hi]]).tolist())
        order = np.argsort(np.array(rows, np.int64), kind="stable")
        arrays = [pa.array(v, t).take(pa.array(order)) for v, t in zip(parts.values(), (pa.int32(), pa.int64(), pa.list_(pa.int32())), strict=True)]
        return _lists(len(texts.first) - 1, np.array(rows, np.int64)[order], pa.StructArray.from_arrays(arrays, list(parts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _texts(batch.column(1), index, size):
                n, found = len(texts.first) - 1, places(texts)
                at = np.concatenate(found)
                of = texts.of[at]
                phrase = np.repeat(np.arange(len(found)), [len(f) for f in found])
                word = at - texts.first[of]
                low, high, some = np.full(n, np.iinfo(np.int64).max), np.full(n, -1), np.bincount(of, minlength=n)
                np.minimum.at(low, of, word)
                np.maximum.at(high, of, word)
                base = np.unique(of * len(found) + phrase)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.row, n).cast(id_type), pa.array(np.diff(texts.first), pa.int64()), pa.array(some, pa.int64()),
                        pa.array(low, pa.int64(), mask=some == 0), pa.array(high, pa.int64(), mask=some == 0),
                        _lists(n, base // len(found), pa.array(base % len(found), pa.int32())), blocks(texts),
                    ],
                    names=["id", "n_words", "n_base", "first_word", "last_word", "base", "blocks"],
                )

    return run


def license_blocks(scanned: DataFrame, index: Index, rank: np.ndarray, needs: list[int]) -> DataFrame:
    """(row, template, block, overlap): every block of the documents `scanned` (row, blocks) that contains a template."""
    spark = scanned.sparkSession
    keys, whole = [], []
    for t, (words, step, need) in enumerate(zip(index.sets, index.steps, needs, strict=True)):
        own = sorted(int(rank[w]) for w in words)
        keys += [(t, step, need, len(own), word, at) for at, word in enumerate(own[: len(own) - need + 1])]
        whole.append((t, own))
    prefixes = F.broadcast(spark.createDataFrame(keys, "template int, step int, need int, size int, word int, at int"))
    templates = F.broadcast(spark.createDataFrame(whole, "template int, template_words array<int>"))
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.step", "b.block", F.col("b.words").alias("words"))
    keyed = blocks.select("*", F.posexplode("words").alias("block_at", "word"))
    met = keyed.join(prefixes, ["step", "word"]).filter(F.least(F.size("words") - F.col("block_at"), F.col("size") - F.col("at")) >= F.col("need"))
    # a pair goes on at its first shared key: nothing is shared before it
    before = lambda c, n: F.slice(c, F.lit(1), F.col(n))
    near = met.join(templates, "template").filter(~F.arrays_overlap(before("words", "block_at"), before("template_words", "at")))
    checked = near.withColumn("overlap", F.size(F.array_intersect("words", "template_words"))).filter(F.col("overlap") >= F.col("need"))
    return checked.select("row", "template", "block", "overlap")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=PHRASES, percent: int = PERCENT, slice_bytes: int = SLICE) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score): score is the greatest share of a template's
    words in a block that contains it, 1 where a phrase stands, else 0."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "licenses")
    index = Index.of(templates, phrases)
    needs = index.needs(percent)
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    counts = np.zeros(len(index.vocabulary), np.int64)
    for r in rows.select("text").mapInArrow(_count(index, slice_bytes), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        counts[r["word"]] = r["n"]
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    id_type = rows.schema["id"].dataType
    documents = rows.mapInArrow(_scan(index, rank, needs, to_arrow_type(id_type), slice_bytes), DOCUMENT.format(id=id_type.simpleString()))
    # rows of one id are told apart by numbers that the written table fixes
    scanned = scratch.put(documents.withColumn("row", F.monotonically_increasing_id()))
    found = license_blocks(scanned, index, rank, needs)
    label = F.lit([label for label in index.labels])
    size = F.lit([len(s) for s in index.sets])
    share = F.col("overlap") / F.get(size, F.col("template"))
    matched = found.groupBy("row").agg(F.collect_set(F.get(label, F.col("template"))).alias("more"), F.max(share).alias("share"))
    matched = matched.withColumnRenamed("row", "of_row")
    fixed = F.lit([label for _, label in phrases])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda k: F.get(fixed, k))))
    out = scanned.drop("blocks").join(matched, F.col("row") == F.col("of_row"), "left").withColumn("base_labels", base)
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"),
    )


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all texts of documents."""
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sql() -> str:
    index = Index.of(TEMPLATES, PHRASES)
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ",\n  ".join(f"('{label}', {step}, {listed(sorted({*template_words(text)}))})" for (label, text), step in zip(TEMPLATES, index.steps, strict=True))
    phrases = ", ".join(f"('{label}', {listed(template_words(text))})" for text, label in PHRASES)
    return rf"""
WITH templates(label, step, tw) AS (VALUES
  {templates}),
phrases(label, pw) AS (VALUES {phrases}),
texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(w) - len(pw) + 2), lambda i: w[i:i + len(pw) - 1] = pw)) - 1 AS spot FROM texts, phrases
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id
),
windows AS (
  SELECT doc_id, step, list_distinct(w[b * step + 1:b * step + 2 * step]) AS block
  FROM (SELECT doc_id, w, step, unnest(range(0, greatest(0, (len(w) + step - 1) // step - 2) + 1)) AS b FROM texts, (SELECT DISTINCT step FROM templates) AS steps)
),
more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(o / n) AS share
  FROM (SELECT doc_id, label, len(list_intersect(block, tw)) AS o, len(tw) AS n FROM windows JOIN templates USING (step))
  WHERE 100 * o >= {PERCENT} * n GROUP BY doc_id
)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(m.labels, [])))), ',') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0)::DOUBLE END AS score
FROM texts t LEFT JOIN base b USING (doc_id) LEFT JOIN more m USING (doc_id)
"""


OP13_SQL = _sql()
