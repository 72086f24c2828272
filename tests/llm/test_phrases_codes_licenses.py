"""Phrases, vector codes and licenses against brute force on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpusloom.llm import licenses, phrases, textgrams, topk, vector_codes

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LARGEST = 2**63 - 1

# --- phrases --------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, share, top, max_n=4):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, max_n + 1):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if any(len(q) > len(p) and inside(q) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, _, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def odd_texts(seed=3, n=120):
    rng = random.Random(seed)
    words = ["New", "york", "CITY", "of", "the", "é", "x y", "a\0b", "日本", "of-the"]
    rows = [(None, "en"), ("", None), ("   \t ", "en"), (".,;", "fr"), ("one", "und")]
    for _ in range(n):
        rows.append(("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", "\n", "  "]) for _ in range(rng.randrange(1, 40))), rng.choice(["en", "fr", None])))
    rows += rows[-20:] * 2  # repeated rows
    rows += [("New York City of the North " * 60, "en"), ("tie up. tie in. " * 9, "fr")]
    return rows


@pytest.mark.parametrize("least, share, top", [(6, 80, 2000), (3, 100, 5), (9, 1, 7)])
def test_phrases_against_brute_force(spark, least, share, top):
    rows = odd_texts()
    df = spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in phrases.phrases(df, least=least, share=share, top=top).collect())
    assert got == brute_phrases(rows, least, share, top)


def test_phrases_of_long_texts_and_full_bit_tables(spark):
    """Texts far longer than a part, and a bit table in which every bit is set."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["a", "bb", "ccc", "dddd.", "e" * 300]) for _ in range(4000))
    rows = [(long, "en"), (long[:1000], "fr"), ("." * 3000 + "a bb a bb" * 9, "en")]
    gap = phrases.GAP
    for n in (1, 2, 4):
        want = Counter(w for t, _ in rows for p in re.split(r"[.,;:!?\x0A-\x0D]", t) for k in [p.split()] for w in zip(*[k[i:] for i in range(n)], strict=False))
        data, offsets = textgrams.text_bytes(__import__("pyarrow").array([t for t, _ in rows]))
        got = Counter()
        for part, local, _ in textgrams.text_parts(data, offsets, gap, n, size=512):
            words, ids, piece, _ = phrases.runs(part, local)
            names = words.to_pylist()
            got.update(tuple(names[j] for j in ids[i : i + n]) for i in range(len(ids) - n + 1) if piece[i] == piece[i + n - 1])
        assert got == want
    got = sorted(tuple(r) for r in phrases.phrases(spark.createDataFrame(rows, "text string, lang string"), least=4, filter_bits=6).collect())
    assert got == brute_phrases(rows, 4, 80, 2000)


def test_no_phrases(spark):
    assert phrases.phrases(spark.createDataFrame([], "text string, lang string")).collect() == []
    with pytest.raises(ValueError):
        phrases.phrases(spark.createDataFrame([("a", "b")], "text string, lang string"), max_n=1)


# --- vector codes ---------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """(id, code, error, label error, digest) with Python integers only."""
    kept = [(i, label, v) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    wide = -(-max((len(v) for _, _, v in kept), default=0) // parts)
    whole = lambda x: max(-(2**62), min(2**62, math.floor(1024 * x) if abs(x) < 1e300 else (2**62 if x > 0 else -(2**62))))
    vec = [[whole(x) for x in v] + [0] * (parts * wide - len(v)) for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    part = lambda v, p: v[p * wide : (p + 1) * wide]
    book = [[part(vec[k], p) for k in first] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((apart(part(v, p), e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for p in range(parts)] for v in vec]
        for p in range(parts):
            for e in range(len(first)):
                own = [part(v, p) for v, f in zip(vec, found, strict=True) if f[p] == e]
                if own:
                    book[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [[near(v, p) for p in range(parts)] for v in vec]
    errors = [min(sum(d for d, _ in f), LARGEST) for f in last]
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    of = Counter()
    for (_, label, _), e in zip(kept, errors, strict=True):
        of[label] += e
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, min(of[label], LARGEST), digest) for (i, label, _), f, e in zip(kept, last, errors, strict=True)), key=str)


def odd_vectors(kind, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 2, None]), [rng.gauss(rng.choice([-1, 0, 1]), 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(500, 1, None), (501, 1, [1.0, None] * 4), (502, 2, [float("nan")] * 8), (503, 2, [float("inf")] * 8), (3, 1, [0.5] * 8), (3, 1, [0.25] * 8), (None, 1, [0.1] * 8)]
    rows += rows[:9]
    if kind == "short":
        rows += [(600, 1, [0.5, 0.5, 0.5]), (601, None, []), (602, 2, [1.0] * 9)]
    if kind == "large":
        rows += [(-1, 1, [1e30] * 8), (-2, 2, [-1e12, 1e12] * 4), (-3, 2, [1e8] * 8)]
    if kind == "ties":
        rows = [(i, i % 3, [float(rng.randrange(2)) for _ in range(8)]) for i in range(300)]
    return rows


@pytest.mark.parametrize("kind", ["plain", "short", "large", "ties"])
def test_codes_against_brute_force(spark, kind):
    rows = odd_vectors(kind)
    df = spark.createDataFrame([(i, label, v, "c") for i, label, v in rows], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    got = sorted((tuple(r) for r in vector_codes.vector_codes(df, entries=16, block_bytes=2048).collect()), key=str)
    assert got == brute_codes(rows, 4, 16, 4)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(7, None, [0.5] * 8), (2, None, [0.25] * 8)]
    got = sorted(tuple(r) for r in vector_codes.vector_codes(spark.createDataFrame(rows, schema)).collect())
    assert [r[:4] for r in got] == [(2, "00000000", 0, 0), (7, "01010101", 0, 0)]
    assert vector_codes.vector_codes(spark.createDataFrame([(1, 1, None)], schema)).collect() == []
    assert vector_codes.vector_codes(spark.createDataFrame([], schema)).collect() == []


def test_heaps_pop_only_what_drift_has_reached():
    keys, codes = np.array([3.0, 1.0, 2.0, 5.0, 0.5]), np.array([0, 0, 1, 1, 1])
    heaps = vector_codes.Heaps.of(codes, keys.copy(), 3)
    assert sorted(heaps.pop(np.array([1.5, 0.4, 9.0])).tolist()) == [1]
    heaps.push(np.array([1]), np.array([1]), np.array([0.1]))
    heaps.close()
    assert sorted(heaps.pop(np.array([0.0, 0.5, 0.0])).tolist()) == [1, 4]
    heaps.close()
    assert sorted(heaps.order.tolist()) == [0, 2, 3] and heaps.tops.tolist() == [0, 1, 3, 3]


def test_later_rounds_rescan_few(spark):
    """Parts far from all entries but their own are never popped."""
    rng = random.Random(2)
    centres = [[rng.randrange(-50, 50) * 4.0 for _ in range(8)] for _ in range(8)]
    points = np.array([[c + rng.gauss(0, 0.01) for c in centres[i % 8]] for i in range(400)])
    whole = vector_codes.to_integers(points)
    book = whole[:8].reshape(8, 4, 2).transpose(1, 0, 2)
    code, slack = vector_codes.nearest(whole[:, :2], book[0])
    heaps = vector_codes.Heaps.of(code, slack, 8)
    after = np.stack([whole[code == e, :2].sum(0) // max(1, (code == e).sum()) for e in range(8)])
    drift = vector_codes._drift(book[:1], after[None])[0]
    assert len(heaps.pop(drift)) < 40


# --- thresholds of the top-k search ---------------------------------------------------------------------------


def test_shards_after_the_first_prune_and_so_do_floors(spark, monkeypatch):
    """Scores are those of brute force over many shards, parts and a pilot; a threshold saves products from the first shard on."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    points = (centres[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 16)) * 0.2).astype(np.float32)
    whole = topk.to_integers(points, 1024)
    queries, ids = whole[:40], np.arange(3000)
    scores = (queries @ whole.T).astype(np.int64)
    scores[np.arange(40), np.arange(40)] = -(2**60)
    want = {q: [(int(i), int(scores[q, i])) for i in np.lexsort((ids, -scores[q]))[:10]] for q in range(40)}
    floors = np.sort(scores, axis=1)[:, -10].astype(float)
    cost = {}
    for name, floor in (("none", None), ("known", floors)):
        search = topk.ShardSearch(ids[:40], queries, 10, floor)
        for at in range(0, 3000, 500):
            before = search.products
            search.add(ids[at : at + 500], whole[at : at + 500])
            cost[name, at] = search.products - before
        assert {q: [(i, -s) for s, i in search.best[q]] for q in range(40)} == want
    assert all(cost["none", at] < 0.6 * cost["none", 0] for at in range(500, 3000, 500)) and cost["known", 0] < 0.6 * cost["none", 0]
    monkeypatch.setattr(topk, "PILOT", 200)
    monkeypatch.setattr(topk, "PART", 400)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 15)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in sorted(topk.maxscore_topk(df, df.filter("vec_id < 40")).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    assert got == want


# --- licenses -------------------------------------------------------------------------------------------------


def brute_licenses(text, templates=licenses.TEMPLATES, percent=licenses.PERCENT):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(UPPER))
    w, base, places = find(text or ""), set(), []
    for phrase, label in licenses.PHRASES:
        p = find(phrase)
        own = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += own
        base |= {label} if own else set()
    labels, best = set(base), 0.0
    for label, t in templates:
        p = find(t)
        own, step = set(p), 1 << max(2, (len(p) - 1).bit_length())
        for b in range(max(0, -(-len(w) // step) - 2) + 1):
            shared = len(own & set(w[b * step : (b + 2) * step]))
            if w and 100 * shared >= percent * len(own):
                labels.add(label)
                best = max(best, shared / len(own))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best


def odd_notices(seed=4):
    rng = random.Random(seed)
    texts = [None, "", "   ", "mit", "MIT  License", "the gnu-general.public\nLICENSE and gnu general public license", "cc by cc by", "Licence", "ccby", "émit license", "é" * 50]
    filler = ["lorem", "the", "of", "any", "und", "software", "wörter"]
    for _, notice in licenses.TEMPLATES:
        for change in (0, 1, 6):
            words = notice.split()
            for _ in range(change):
                words[rng.randrange(len(words))] = rng.choice(filler)
            before = [rng.choice(filler) for _ in range(rng.randrange(200))]
            texts.append(" ".join([*before, *words, *before[:7]]))
    return texts + texts[-5:]


@pytest.mark.parametrize("slice_bytes", [2 << 20, 64])
def test_licenses_against_brute_force(spark, slice_bytes):
    texts = odd_notices()
    df = spark.createDataFrame([(i // 2, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, labels string, row int").repartition(3)
    got = sorted((tuple(r) for r in licenses.scan_licenses(df, slice_bytes=slice_bytes).collect()), key=str)
    assert got == sorted(((i // 2, *brute_licenses(t)) for i, t in enumerate(texts)), key=str)


def test_license_templates_are_a_parameter(spark):
    own = (("house", "may be read aloud on Sundays only"), ("short", "copyleft"))
    texts = ["It may be read aloud on sundays.", "copyleft!", "may be read", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df, templates=own, percent=80).collect()}
    assert got == {0: "house", 1: "short", 2: "", 3: ""}
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        licenses.Index.of((("none", "..."),), licenses.PHRASES)
