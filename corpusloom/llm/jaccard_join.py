"""Near-duplicate texts by T-occurrence search over word shingles (DivideSkip), and their components.

Two texts link when the Jaccard similarity of their shingle sets is at least 0.8, compared in whole numbers. With sizes
a and b they then share at least T = ceil(4 (a + b) / 9) shingles.

Where lists are short. A shingle's inverted list holds the texts that have it. In a global order with the frequent
shingles last, a text's first n - ceil(0.8 n) + k(n) shingles are its short lists, k(n) = 1 + n // 20. Two linked texts
share ceil(0.8 n) shingles or more for either n, of which at most ceil(0.8 n) - k(n) lie outside the prefix; so the text
whose prefix ends first has k of the shared ones in it, and they are in the other's prefix too. All candidates meet in k
short lists or more, texts with fewer meetings are out, and the long lists are never built across the corpus. The order
comes from a count of shingles that recur nearby, in a table of fixed size; it need not be exact, only the same for all.

1. Texts of equal sets are one class, named by a hash of the set; copies send one prefix per batch of rows.
2. Prefix shingles are dealt by hash. In a list sorted by size, classes without a neighbour of fitting size go; so do
   classes left in fewer lists than k of the smallest size that fits theirs.
3. In rounds, every class is paired with a few others: in each of ORDERS hash orders, of the leaders of its lists (the
   first class of a run of fitting sizes) the one it meets most. Pairs whose parity bitmaps rule T out (sets differ in at
   least as many elements as their bitmaps in bits) go. The others are searched, and links join components: a group of
   near copies becomes one after a round or two, without its pairs. A round's pairs grow with the classes, not with the
   groups.
4. Lists that still hold several components, one of those with equal members, are looked through for pairs across
   components, with the same bounds, in blocks; a pair counts in the first open list that both classes have. So every
   pair that shares a prefix shingle is either inside one component, ruled out by a bound, or searched.
5. A search takes a text as query and its candidates as the indexed texts. T - L occurrences are asked of the short
   lists, which are merged; the L longest lists are only probed, by binary search, for candidates that reached it. The
   overlap is then exact.

Components need no more: a link that is not searched joins texts that are already joined. An exact run leaves step 3
out and takes each class for a component in step 4: every link between different texts is found, at the price of the
pairs of each group.

Defined results: texts without words, null included, have an empty set and link with nothing; with fewer words than a
shingle the whole sequence is the only element; a null id gets a null component and links with nothing; rows of equal id
are judged by their own texts and an id's component is that of each row; an empty table gives an empty table; columns
named like the added ones are replaced. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import Scratch, table
from corpusloom.llm.components import components
from corpusloom.llm.textgrams import mix, ngrams, slices, text_bytes, words_of

SHINGLE, PERCENT = 5, 80
CELL_BITS = 18
MAX_SIGN_BITS = 1 << 16
#: Candidates of a group, about.
GROUP = 256
ORDERS, ROUNDS = 4, 2
#: Rows of an open list beyond which it is cut into blocks, and the open lists of a class that its rows carry.
LIST_ROWS, CARRIED, REMEMBERED = 512, 32, 200_000


def required(a, b, percent: int = PERCENT):
    """The least overlap of linked sets of sizes a and b."""
    return -((-percent * (a + b)) // (100 + percent))


def meetings(n):
    """k: in how many short lists a text of n shingles meets a linked one, if its prefix ends first."""
    return 1 + n // 20


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """For each row its sorted distinct shingle hashes."""
    words = words_of(column, lower=True)
    grams = ngrams(words.hashes, size)
    for i in range(len(words.first) - 1):
        lo, hi = int(words.first[i]), int(words.first[i + 1])
        n = hi - lo
        if n >= size:
            yield i, np.unique(grams[lo : hi - size + 1])
        elif n:
            yield i, ngrams(words.hashes[lo:hi], n)
        else:
            yield i, grams[:0]


def set_name(s: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    one, two = (int(mix(x).sum(dtype=np.uint64)) for x in (s, s ^ np.uint64(0x5851F42D4C957F2D)))
    name = (one * 0x9E3779B97F4A7C15 + two) % (1 << 64)
    return name - (1 << 64) if name >> 63 else name


def _count_nearby(size: int):
    """Shingles that occur twice or more within a slice of rows, counted in cells; each task sends its non-empty cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                words = words_of(part.column(0), lower=True)
                grams = ngrams(words.hashes, size)
                if not len(grams):
                    continue
                starts = np.arange(len(grams))
                room = np.repeat(words.first[1:], words.counts)[: len(grams)] - starts
                own = np.sort(grams[room >= size])
                edges = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
                runs = np.diff(edges)
                many = runs > 1
                np.add.at(cells, (own[edges[:-1]][many] >> np.uint64(64 - CELL_BITS)).astype(np.int64), runs[many])
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    return run


def sign(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: at least four bits for each element, which makes the bound nearly exact; a power of two
    in number, so that larger ones fold."""
    bits = min(MAX_SIGN_BITS, max(64, 1 << int(4 * len(s) - 1).bit_length()))
    at = (mix(s + np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def fold(x: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to size bytes: a bit's place modulo the new length."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def possible(a, b, differing, percent: int = PERCENT):
    """Whether sets of sizes a and b that differ in at least so many elements can link."""
    low, high = np.minimum(a, b), np.maximum(a, b)
    most = np.minimum((a + b - differing) // 2, low)
    return (100 * low >= percent * high) & (most >= required(a, b, percent))


def short_lists(s: np.ndarray, cells: np.ndarray, percent: int) -> np.ndarray:
    """The shingles of a set whose inverted lists are built across the corpus: the first in the global order."""
    n = len(s)
    take = min(n, n - -(-percent * n // 100) + meetings(n))
    rank = cells[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
    return s[np.argsort(rank, kind="stable")[:take]] if rank.any() else s[:take]


def _describe(size: int, percent: int, cells: np.ndarray):
    """Per row: id, text hash, set size, class; for the first row with an id of a class in a slice also its bitmap and short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                ns, names, signs, prefixes, known = [], [], [], [], set()
                for i, s in shingle_sets(part.column(2), size):
                    name = set_name(s) if len(s) else None
                    ns.append(len(s))
                    names.append(name)
                    # rows without id are left out later, and what they carry with them
                    carries = name is not None and name not in known and part.column(0)[i].is_valid
                    signs.append(sign(s) if carries else None)
                    prefixes.append(short_lists(s, cells, percent).view(np.int64) if carries else None)
                    if carries:
                        known.add(name)
                made = [pa.array(ns, pa.int64()), pa.array(names, pa.int64()), pa.array(signs, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], names=["id", "th", "n", "c", "sig", "prefix"])

    return run


def _bound(percent: int):
    """Pairs with sizes and bitmaps in; pairs that the bounds leave possible out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            differing = np.zeros(len(a), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                differing[i] = int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())
            ok = possible(na, nb, differing, percent)
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows as batches that end where a group ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(key).to_numpy()
        changes = np.flatnonzero(g[1:] != g[:-1])
        if held and held[-1].column(key)[-1].as_py() != g[0]:
            yield _joined(held)
            held = []
        if len(changes):
            cut = int(changes[-1]) + 1
            yield _joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if len(parts) > 1 else parts[0]


def _across(percent: int):
    """Open lists, or pairs of blocks of them, sorted by group and size in; possible pairs of different components out, smaller
    name first. Of two blocks only pairs across count: each block meets itself elsewhere. A pair counts in the first list
    that both classes carry, so it is sent once unless their first shared list lies beyond what they carry."""

    def first_shared(own: list[np.ndarray], i: np.ndarray, j: np.ndarray, h: int) -> np.ndarray:
        out = np.ones(len(i), bool)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
            a, b = own[x], own[y]
            at = np.searchsorted(b, a)
            shared = a[(at < len(b)) & (b[np.minimum(at, len(b) - 1)] == a)]
            out[k] = not len(shared) or shared[0] >= h
        return out

    def pairs(h: int, n: np.ndarray, c: np.ndarray, comp: np.ndarray, side: np.ndarray, carried: list[np.ndarray], sigs: list[np.ndarray], found: set) -> Iterator[None]:
        width = np.array([len(s) for s in sigs])
        for w in np.unique(width):
            near = np.flatnonzero((width == w) | (width == 2 * w))
            own = np.flatnonzero(width[near] == w)
            if len(near) < 2:
                continue
            rows = np.stack([fold(sigs[i], w) for i in near])
            for at in range(0, len(own), GROUP):
                left = own[at : at + GROUP]
                for to in range(0, len(near), GROUP):
                    right = np.arange(to, min(to + GROUP, len(near)))
                    i, j = near[left], near[right]
                    ok = (comp[i][:, None] != comp[j][None, :]) & ((side[i][:, None] == 0) | (side[i][:, None] != side[j][None, :]))
                    low, high = np.minimum(n[i][:, None], n[j][None, :]), np.maximum(n[i][:, None], n[j][None, :])
                    ok &= 100 * low >= percent * high
                    # of two classes of one width each pair comes up twice
                    ok &= (width[j][None, :] != w) | (c[i][:, None] < c[j][None, :])
                    u, v = np.nonzero(ok)
                    if not len(u):
                        continue
                    differing = np.bitwise_count(rows[left[u]] ^ rows[right[v]]).sum(axis=1, dtype=np.int64)
                    good = possible(n[i[u]], n[j[v]], differing, percent)
                    x, y = i[u[good]], j[v[good]]
                    first = first_shared(carried, x, y, h)
                    x, y = c[x[first]], c[y[first]]
                    found.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True))
                    yield

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        found: set[tuple[int, int]] = set()

        def fresh() -> Iterator[pa.RecordBatch]:
            new = found - sent
            found.clear()
            if len(sent) > REMEMBERED:
                sent.clear()
            sent.update(new)
            if new:
                a, b = zip(*new, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in _groups(batches, 0):
            g, h, c, n, comp, side = (batch.column(k).to_numpy() for k in range(6))
            lists, sigs = batch.column(6), batch.column(7)
            edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                own = [np.frombuffer(sigs[i].as_buffer(), np.uint8) for i in range(lo, hi)]
                carried = [lists[i].values.to_numpy() for i in range(lo, hi)]
                for _ in pairs(int(h[lo]), n[lo:hi], c[lo:hi], comp[lo:hi], side[lo:hi], carried, own, found):
                    if len(found) > REMEMBERED:
                        yield from fresh()
            yield from fresh()

    return run


class InvertedLists:
    """The lists of a few texts: for each shingle the texts that have it, in ascending order."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        values = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], np.repeat(np.arange(len(texts)), self.sizes)[order]

    def of(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the list of each shingle of a query begins and ends."""
        return np.searchsorted(self.values, query, "left"), np.searchsorted(self.values, query, "right")


def t_occurrence(query: np.ndarray, texts: list[np.ndarray], percent: int = PERCENT, mu: float = 0.01) -> list[tuple[int, int]]:
    """(text, overlap) of the texts that share enough of the query's shingles, by DivideSkip.

    With T the least overlap of any text of fitting size, the L = T / (mu log2(longest) + 1) longest lists are set apart.
    The short ones are merged by a heap; a text that comes up T - L times or more there is probed for in the long lists by
    binary search, as long as the lists left can still lift it to its own T."""
    index = InvertedLists(texts)
    need = required(len(query), index.sizes, percent)
    fits = (100 * np.minimum(index.sizes, len(query)) >= percent * np.maximum(index.sizes, len(query))) & (index.sizes > 0)
    if not fits.any():
        return []
    least = int(need[fits].min())
    begins, ends = index.of(query)
    lengths = ends - begins
    longest = int(lengths.max(initial=1))
    n_long = max(0, min(least - 1, int(least / (mu * math.log2(max(2, longest)) + 1))))
    ranked = np.argsort(lengths, kind="stable")
    owner = index.owner
    lists = [owner[begins[k] : ends[k]].tolist() for k in ranked]
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for text, run in groupby(merge(*short)):
        count, left = sum(1 for _ in run), n_long
        wanted = int(need[text])
        if not fits[text] or count + left < wanted:
            continue
        for postings in reversed(long):
            if count + left < wanted:
                break
            at = bisect_left(postings, text)
            count += at < len(postings) and postings[at] == text
            left -= 1
        if not left and count >= wanted:
            out.append((text, count))
    return out


def _search(size: int, percent: int):
    """Groups of a query and its candidates in, queries first, with their texts; links out. A group streams past: its query's set
    is held, and the sets of SLICE bytes of candidates at a time, or of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, query = None, None
        for batch in batches:
            for part in slices(batch, 3):
                if not len(part):
                    continue
                g, is_query, c = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False), part.column(2).to_numpy()
                # a row that only shares the id of a class is another text
                sets = {i: s for i, s in shingle_sets(part.column(3), size) if len(s) and set_name(s) == c[i]}
                edges = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
                out: list[tuple[int, int, int]] = []
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if now is None or g[lo] != now:
                        now, query = g[lo], None
                    if query is None:
                        query = next(((int(c[i]), sets[i]) for i in range(lo, hi) if is_query[i] and i in sets), None)
                    own = [i for i in range(lo, hi) if not is_query[i] and i in sets]
                    if query is not None and own:
                        out += [(query[0], int(c[own[k]]), n) for k, n in t_occurrence(query[1], [sets[i] for i in own], percent)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["a", "b", "overlap"])

    return run


class JaccardJoin:
    """The join over one table; `members` (id, n, c) holds the class of each row after a run, `links` (a, b, overlap) every
    pair of linked classes once after an exact run. Other runs search what components need and have no links to show.

    All joins are sort-merge joins: no side has a size bound, and one plan serves every size."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT):
        self.spark, self.size, self.percent = df.sparkSession, size, percent
        self.scratch = Scratch(self.spark, "jaccard")
        self.rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("t"))

    def _order(self) -> np.ndarray:
        """The rank of each cell: the number of bits of its count. The table's size does not depend on the corpus."""
        cells = np.zeros(1 << CELL_BITS, np.uint8)
        counted = self.rows.select("t").mapInArrow(_count_nearby(self.size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
        for part in counted.select("cell", F.floor(F.log2("n")).cast("int").alias("rank")).toArrow().to_batches():
            cells[part.column(0).to_numpy()] = np.minimum(part.column(1).to_numpy() + 1, 60)
        return cells

    def _verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Links among pairs (a: query, b); a query with many candidates becomes several groups."""
        many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("k"))
        split = pairs.join(many.hint("merge"), "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / F.lit(GROUP))))
        split = split.select(F.xxhash64("a", "salt").alias("g"), "a", "b")
        roles = split.select("g", F.lit(False).alias("q"), F.col("b").alias("c")).union(
            split.groupBy("g", "a").agg(F.lit(1).alias("one")).select("g", F.lit(True).alias("q"), F.col("a").alias("c"))
        )
        dealt = roles.join(texts.hint("merge"), "c").select("g", "q", "c", "t").repartition("g").sortWithinPartitions("g", F.desc("q"))
        return dealt.mapInArrow(_search(self.size, self.percent), "a long, b long, overlap long")

    def _placed(self, shared: DataFrame, joined: DataFrame | None) -> DataFrame:
        """Lists with the component of each class."""
        if joined is None:
            return shared.withColumn("component", F.col("c"))
        return shared.join(joined.select(F.col("node").alias("c"), "component").hint("merge"), "c", "left").withColumn("component", F.coalesce("component", "c"))

    def _across(self, open_lists: DataFrame, signs: DataFrame) -> DataFrame:
        """Possible pairs (a, b) across components. A list is a group; a longer one is cut into blocks, and each pair of blocks
        is a group."""
        open_lists = self.scratch.put(open_lists)
        blocks = open_lists.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIST_ROWS)).cast("int").alias("blocks"))
        carried = open_lists.groupBy("c").agg(F.slice(F.array_sort(F.collect_set("h")), 1, CARRIED).alias("carried"))
        of_class = signs.select("c", "sig").join(carried.hint("merge"), "c")
        cut = open_lists.join(blocks.hint("merge"), "h").withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")).join(of_class.hint("merge"), "c")
        met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("own", "other"), F.greatest("own", "other")
        group = F.when(F.col("blocks") > 1, F.xxhash64("h", low, high)).otherwise(F.col("h"))
        side = F.when(low != high, (F.col("own") == high).cast("int") + 1).otherwise(0)
        met = met.select(group.alias("g"), "h", "c", "n", "component", side.alias("side"), "carried", "sig")
        dealt = met.repartition("g").sortWithinPartitions("g", "n", "c")
        return dealt.mapInArrow(_across(self.percent), "a long, b long").groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")

    def run(self, exact: bool = False) -> DataFrame:
        """(id, n_shingles, component_id, text_hash, is_first), a row for each row; is_first: the component's least id and text
        hash, or linked with nothing. exact: pairs inside components are searched too."""
        put, drop = self.scratch.put, self.scratch.drop
        cells = self._order()
        described = put(self.rows.mapInArrow(_describe(self.size, self.percent, cells), "id long, th long, n long, c long, sig binary, prefix array<long>"))
        known = described.filter("id IS NOT NULL AND c IS NOT NULL")
        postings = described.filter("prefix IS NOT NULL").select("c", F.col("n").cast("int").alias("n"), F.explode("prefix").alias("h"))
        # one row for each class of a list; both steps use the exchange by shingle
        listed = postings.repartition("h").groupBy("h", "c").agg(F.min("n").alias("n"))
        over = Window.partitionBy("h").orderBy("n", "c")
        fits = lambda a, b: F.coalesce(100 * a >= self.percent * b, F.lit(False))
        near = listed.withColumn("down", fits(F.lag("n").over(over), F.col("n"))).withColumn("up", fits(F.col("n"), F.lead("n").over(over)))
        near = near.withColumn("run", F.sum((~F.col("down")).cast("int")).over(over)).filter("down OR up")
        met = put(near.select("h", F.col("run").cast("int").alias("run"), "c", F.col("n").cast("int").alias("n")))
        self.scratch.free()
        # the smallest fitting size is ceil(percent of n); its k is the least number of meetings with it
        least_k = F.floor(F.ceil(F.col("n") * F.lit(self.percent) / 100) / 20) + 1
        wanted = put(met.groupBy("c", "n").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= least_k).select("c"), met.count())
        classes = wanted.count()
        shared = put(met.join(wanted.hint("merge"), "c", "left_semi"))
        drop(met)
        self.scratch.free()
        signs = put(known.filter("sig IS NOT NULL").join(wanted.hint("merge"), "c", "left_semi").groupBy("c").agg(F.min("n").alias("n"), F.min("sig").alias("sig")))
        first = put(known.select("id", "th", "c").join(wanted.hint("merge"), "c", "left_semi").groupBy("c").agg(F.min(F.struct("id", "th")).alias("m")).select("c", "m.id", "m.th"), classes)
        members = put(described.select("id", "th", "n", "c"))
        drop(described)
        self.scratch.free()
        texts = put(self.rows.join(first.hint("merge"), ["id", "th"]).select("c", "t"))
        self.scratch.free()
        left, right = (signs.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}")) for x in "ab")
        tested = joined = None
        for turn in range(0 if exact else ROUNDS):
            placed = self._placed(shared, joined)
            placed = placed.select("h", "run", "c", "component").repartition("h")
            lists = Window.partitionBy("h", "run")
            firsts = [F.min(F.struct(F.xxhash64("c", F.lit(turn * ORDERS + i)).alias("k"), "c", "component")).over(lists) for i in range(ORDERS)]
            led = placed.withColumn("lead", F.array(*firsts)).select("c", "component", F.posexplode("lead").alias("i", "lead"))
            led = led.filter("component <> lead.component").groupBy("c", "i", F.col("lead.c").alias("a")).agg(F.count(F.lit(1)).alias("k"))
            stars = led.groupBy("c", "i").agg(F.max(F.struct("k", "a"))["a"].alias("a")).groupBy("a", F.col("c").alias("b")).agg(F.lit(1).alias("one")).select("a", "b")
            if tested is not None:
                stars = stars.join(tested.hint("merge"), ["a", "b"], "left_anti")
            full = stars.join(right.hint("merge"), "b").join(left.hint("merge"), "a").filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
            bounded = put(full.select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(_bound(self.percent), "a long, b long"), ORDERS * classes)
            tested = bounded if tested is None else tested.union(bounded)
            found = put(self._verify(bounded, texts), ORDERS * classes)
            known_links = found.select("a", "b") if joined is None else joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found.select("a", "b"))
            self.scratch.free()
            joined = put(components(known_links, scratch=self.scratch, most=(1 + ORDERS) * classes), classes)
        placed = self._placed(shared, joined)
        # lists of several components; of lists with equal members one is enough
        mixed = placed.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("c")).alias("who")).filter("low <> high")
        mixed = mixed.groupBy("k", "who").agg(F.min("h").alias("h")).select("h")
        more = self._across(placed.join(mixed.hint("merge"), "h").select("h", "c", "n", "component"), signs)
        if tested is not None:
            more = more.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).hint("merge"), ["a", "b"], "left_anti")
        more = put(more)
        searched = more.count()
        self.scratch.free()
        found = put(self._verify(more, texts), searched)
        self.scratch.free()
        self.links = found if exact else None
        for done in (shared, signs, texts, more):
            drop(done)
        # what is left to join: first components as nodes
        roots = found.select("a", "b") if joined is None else joined.withColumnRenamed("node", "a").union(found.select("a", "b"))
        final = components(roots.toDF("a", "b"), scratch=self.scratch, most=classes + searched)
        self.members = members
        placed = members.join(final.select(F.col("node").alias("c"), "component").hint("merge"), "c", "left").withColumn("component", F.coalesce("component", "c"))
        least = placed.filter("id IS NOT NULL AND c IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "th")).alias("least"))
        out = placed.join(least.hint("merge"), "component", "left")
        linked = F.col("id").isNotNull() & F.col("c").isNotNull()
        own = (F.col("id") == F.col("least.id")) & F.col("th").eqNullSafe(F.col("least.th"))
        return out.select(
            "id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("c").isNull(), F.col("id")).when(linked, F.col("least.id")).alias("component_id"),
            F.col("th").alias("text_hash"),
            (~linked | own).alias("is_first"),
        )


def near_duplicate_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of df."""
    out = JaccardJoin(df, id_col, text, size, percent).run()
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id")


def near_duplicate_links(df: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Every link between different texts: pairs of classes (a, b, overlap), and the members (id_col, class) of classes."""
    join = JaccardJoin(df, id_col, text, size, percent)
    join.run(exact=True)
    return join.links, join.members.filter("id IS NOT NULL AND c IS NOT NULL").select(F.col("id").alias(id_col), F.col("c").alias("class"))


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of least id (and least text hash) of each group; rows without id or words stay. Rows are told apart by id and
    text: of rows equal in both all stay or none."""
    later = JaccardJoin(df, id_col, text).run().filter("NOT is_first").groupBy(F.col("id").alias("later_id"), F.col("text_hash").alias("later_hash")).agg(F.lit(1).alias("one"))
    return df.join(later, (F.col(id_col).cast("long") == later["later_id"]) & (F.xxhash64(text) == later["later_hash"]), "left_anti")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents grouped by links of similarity 0.8 or more on five-word shingles."""
    return near_duplicate_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
