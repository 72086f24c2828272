"""Rows of one id that differ, hot keys, texts that would be quadratic, damaged files: each against brute force or a plain second form."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from html import unescape

import duckdb
import numpy as np
import pytest
import zstandard
from corpusloom.llm import bpe, embedding_dedup, jaccard_join, mixing, quality, secrets, substring_dedup, textgrams, topk, warc
from corpusloom.llm.common import shared_dir
from corpusloom.llm.queries import QUERIES

from tests.llm.test_ops import DOCS, base_spans, jaccard_brute, jaccard_fixture, repeats_brute, texts_of


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


# --- rows of one id that differ --------------------------------------------------------------------------------


def test_embedding_rows_of_one_id(spark):
    a, b = np.eye(16)[0], np.eye(16)[1]
    near = lambda v, k: [float(x) for x in v + 0.01 * np.eye(16)[5 + k]]
    rows = [(0, near(a, 0), 1), (0, near(b, 0), 1), (1, near(a, 1), 1), (2, near(b, 1), 1), (3, near(b, 2), 1)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (2, 2, 0), (3, 2, 0)]


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324])
def test_embedding_extreme_sizes(spark, size):
    rows = [(1, [size, size, 0.0], 1), (2, [1.0, 1.0, 0.0], 1), (3, [size, -size, size], 1)]
    got = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_jaccard_rows_of_one_id(spark):
    one, other = words(40, 1), words(40, 2)
    df = spark.createDataFrame([(2, one), (5, one), (5, other), (5, None), (None, one), (8, other + " tail")], DOCS)
    kept = sorted(((r["doc_id"] or -1), r["text"] or "") for r in jaccard_join.keep_one_of_each(df).collect())
    assert kept == sorted([(2, one), (5, other), (5, ""), (-1, one)])
    same = spark.createDataFrame([(5, one), (5, one + " tail"), (9, one)], DOCS)
    assert jaccard_join.keep_one_of_each(same).count() == 1


def test_substring_rows_of_one_id(spark):
    one, other = words(40, 1), words(40, 2)
    df = spark.createDataFrame([(1, one), (2, one), (2, other), (2, other), (None, one)], DOCS)
    got = sorted(((r["doc_id"] or -1), r["text"] == one, r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == sorted([(1, True, 0), (2, True, 40), (2, False, 0), (2, False, 0), (-1, True, 0)])


def test_mixing_rows_without_id(spark):
    rows = [(None, "a", f"text {i}") for i in range(4000)] + [(7, "a", f"t {i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(df, total=4005.0)
    per = Counter(r["text"] for r in out.filter("doc_id IS NULL").collect())
    assert abs(sum(per.values()) - 4000) < 5 * math.sqrt(4000) and len(set(per.values())) > 3
    assert out.select("shuffle_key").distinct().count() > 3000


def test_topk_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9]), (2, [-1e9, -1e9]), (3, [1.0, 2.0]), (4, [1e9, 1e9])], "vec_id long, embedding array<double>")
    got = [(r["id"], r["score"]) for r in topk.maxscore_topk(df, df.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, 1024 * 10**9 * (1024 + 2048)), (2, -(2**63))]


def test_topk_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "PART", 60)
    monkeypatch.setattr(topk, "SHARD", 16)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((300, 8)).round(2)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ints = np.floor(vectors * 1024).astype(np.int64)
    want = set()
    for q in range(0, 300, 5):
        best = sorted((-int(ints[q] @ ints[i]), i) for i in range(300) if i != q)[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    got = topk.maxscore_topk(df, df.filter("vec_id % 5 = 0"))
    assert {(r["query_id"], r["rank"], r["id"], r["score"]) for r in got.collect()} == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Union") == 1


# --- hot keys --------------------------------------------------------------------------------------------------


def test_substring_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(textgrams, "SLICE", 400)
    line, rng = "the common line that stands in every text of this small corpus here".split(), random.Random(4)
    rows = []
    for d in range(120):
        own = [f"x{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        rows.append((d, " ".join(own[:10] + line[: rng.randrange(6, 14)] + own[10:] + line)))
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substring_dedup.remove_repeats(df, window=12, anchor=4).collect()}
    assert got == repeats_brute(rows, 12)


def test_jaccard_blocks_of_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 6)
    monkeypatch.setattr(jaccard_join, "CARRIED", 5)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    rows = [x for x in jaccard_fixture(5) if x[0] < 150 or x[0] > 900]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicate_groups(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_query(spark, sf_dir):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op4_jaccard_join"](spark, sf_dir).collect()}
    assert got == jaccard_brute(list(texts_of(sf_dir).items()))


# --- long texts ------------------------------------------------------------------------------------------------


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    text = "a" * 700 + " b c " + "de" * 900 + " f"
    whole = textgrams.words_of(pa.array([text])).hashes.tolist()
    monkeypatch.setattr(textgrams, "CHUNK", 64)
    assert textgrams.words_of(pa.array([text])).hashes.tolist() == whole and len(set(whole)) == 5


def test_long_secrets(spark):
    rng = random.Random(1)
    run = "".join(rng.choice(secrets.SYMBOLS[:64]) for _ in range(400_000))
    many = " ".join(f"token=abcdef{i:05d}" for i in range(30_000))
    runs = "token=abcdefgh " + " ".join(f"Zk8Jq2Lm9Xw4Vb7Nc1Tp{i:05d}q" for i in range(20_000))
    plain = "a-" * 200_000
    began = time.monotonic()
    df = spark.createDataFrame([(1, f"x {run} y"), (2, many), (3, runs), (4, plain), (5, "A-" * 100_000), (6, "a1-" * 100_000)], DOCS)
    rows = {r["doc_id"]: r for r in secrets.redact(secrets.scan_secrets(df)).collect()}
    assert time.monotonic() - began < 120
    assert [(s["start"], s["end"], s["kind"]) for s in rows[1]["all_spans"]] == [(2, 400_002, "base64_entropy")] and rows[1]["text"] == "x [SECRET] y"
    assert [(s["start"], s["ord"], s["end"], s["kind"]) for s in rows[2]["base_spans"]] == base_spans(many)
    assert rows[2]["text"] == " ".join(["[SECRET]"] * 30_000) and rows[3]["text"] == " ".join(["[SECRET]"] * 20_001)
    assert rows[4]["text"] == plain and not rows[5]["all_spans"] and not rows[6]["all_spans"]


@pytest.mark.parametrize("part", ["<a ", "<title>", "<", "<!--", "<script>", "</", "<a href=", "<a href='", "&"])
def test_pages_are_read_in_linear_time(part):
    began = time.monotonic()
    warc.derivatives({"record_id": "r", "target_uri": "http://x.org/", "warc_date": None, "headers": [], "http_status": 200, "http_headers": [], "payload": (part * (1_000_000 // len(part))).encode()})
    assert time.monotonic() - began < 8


# --- archives --------------------------------------------------------------------------------------------------

DROPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
BREAK = re.compile(r"</?(?:%s)\b[^>]*>" % "|".join(sorted(warc.BREAKING, key=len, reverse=True)), re.I)
TAG = re.compile(r"</?[A-Za-z!?][^>]*>")
LINK = re.compile(r"""<(a|link|img|script|iframe|form)\b[^>]*?\s(href|src|action)\s*=\s*("[^">]*"|'[^'>]*'|[^\s>]+)""", re.I)


def by_patterns(page):
    """Text, title and number of links as patterns over the whole page see them: a second form, not linear."""
    text = TAG.sub("", BREAK.sub("\n", DROPPED.sub(" ", page).replace("\n", " ")))
    text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v ]+", " ", unescape(text))).strip()
    title = re.search(r"<title\b[^>]*>(.*?)</title\s*>", page, re.S | re.I)
    return text, title and re.sub(r"[ \t\r\f\v ]+", " ", unescape(title[1]).replace("\n", " ")).strip(), len(LINK.findall(re.sub(r"<!--.*?(?:-->|\Z)", "", page, flags=re.S)))


def test_warc_query_against_patterns(spark):
    sf = "/root/testdata/sf0.01"
    pages = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    want = Counter()
    for _, url, page in pages:
        text, title, n = by_patterns(page or "")
        source = "sha1:" + __import__("base64").b32encode(hashlib.sha1((page or "").encode()).digest()).decode()
        want[url, "conversion", title, n, source, hashlib.sha256(text.encode()).hexdigest()] += 1
        want[url, "metadata", title, n, source, None] += 1
    got = Counter()
    for r in QUERIES["op8_warc_derivatives"](spark, sf).collect():
        block = bytes(r["block"])
        got[r["target_uri"], r["warc_type"], r["title"], r["n_links"], r["source_payload_digest"], hashlib.sha256(block).hexdigest() if r["warc_type"] == "conversion" else None] += 1
        assert r["content_length"] == len(block) and r["block_digest"] == warc.digest(block)
        if r["warc_type"] == "metadata":
            assert json.loads(block)["Envelope"]["WARC-Header-Metadata"]["WARC-Record-ID"] == r["refers_to"]
    assert got == want


def test_warc_headers_and_encodings(spark):
    page = "<title>Café</title><p>naïve"
    squeezed = gzip.compress(page.encode("latin-1"))
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(squeezed[i : i + 9]), squeezed[i : i + 9]) for i in range(0, len(squeezed), 9)) + b"0\r\n\r\n"
    http = [("Set-Cookie", "a=1"), ("Set-Cookie", "b=2"), ("Content-Type", "text/html; charset=ISO-8859-1"), ("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")]
    base = {"record_id": "r", "target_uri": "http://x.org/", "warc_date": "d", "headers": [("WARC-Type", "response"), ("X", "1"), ("X", "2")], "http_status": 200}
    for payload in (chunks, squeezed):
        meta, text = warc.derivatives(base | {"http_headers": http, "payload": payload})
        assert text["block"].decode() == "Café\nnaïve" and meta["title"] == "Café" and meta["source_payload_digest"] == warc.digest(payload)
        inner = json.loads(meta["block"])["Envelope"]
        assert inner["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"]["Set-Cookie"] == ["a=1", "b=2"] and inner["WARC-Header-Metadata"]["X"] == ["1", "2"]
        assert [(h["name"], h["value"]) for h in text["source_headers"]] == base["headers"]
    for coding, payload in (("deflate", zlib.compress(b"<p>ok")), ("deflate", zlib.compress(b"<p>ok")[2:-4]), ("gzip", b"<p>ok"), ("br", b"<p>ok")):
        assert warc.derivatives(base | {"http_headers": [("content-encoding", coding)], "payload": payload})[1]["block"] == b"ok"
    assert warc.derivatives(base | {"http_headers": [("Content-Type", "text/html; charset=none-such")], "payload": "<p>é".encode()})[1]["block"].decode() == "é"
    assert warc.derivatives(base | {"http_headers": [], "payload": b'<meta charset="latin-1"><p>\xe9'})[1]["block"].decode() == "é"


def test_damaged_files(spark, tmp_path):
    def record(n, size=None):
        body = f"HTTP/1.1 200 OK\r\n\r\n<p>{n}".encode()
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {n}\r\nContent-Length: {len(body) if size is None else size}\r\n\r\n".encode() + body + b"\r\n\r\n"

    (tmp_path / "a.warc").write_bytes(record(1) + record(2, "x9") + record(3) + record(4, 10**9))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record(5)) + gzip.compress(record(6) * 50)[:-30])
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(record(7)) + b"\x1f\x8bgarbage")
    got = {r["record_id"] for r in warc.parse_warc(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert {"1", "3", "5", "7"} <= got <= {"1", "3", "5", "6", "7"}
    assert [b for _, b in warc.read_records(io.BytesIO(record(1)))] == [b"HTTP/1.1 200 OK\r\n\r\n<p>1"]


# --- others ----------------------------------------------------------------------------------------------------


def test_quality_query_against_plain_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    kits = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    got = {r["doc_id"]: (r["held_out"], r["score"], r["predicted"]) for r in QUERIES["op1_quality"](spark, sf_dir).collect()}
    texts = texts_of(sf_dir)
    assert set(got) == set(texts)
    for d, text in texts.items():
        data = (text or "").encode()
        good, bad = (sum(len(kit.compress(data[i : i + quality.BLOCK])) for i in range(0, len(data), quality.BLOCK)) for kit in kits)
        score = 1 / (1 + math.exp(-(model.slope * ((bad - good) / len(data) if data else 0.0) + model.offset)))
        assert got[d][0] == (zlib.crc32(str(d).encode()) % 4 == 2) and abs(got[d][1] - score) < 1e-12 and got[d][2] == int(score >= 0.7)


def test_bpe_refuses_other_tokenizers(tmp_path):
    with open(bpe.default_path(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}, {"added_tokens": [spec["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            bpe.MergeTable(str(tmp_path / "t.json"))


def test_shared_folder_is_needed_on_a_cluster():
    class Fake:
        def __init__(self, **conf):
            self.sparkContext, self.conf = self, conf

        def getConf(self):
            return self.conf

    conf = {"spark.master": "spark://host:7077"}
    with pytest.raises(RuntimeError):
        shared_dir(Fake(**conf))
    assert shared_dir(Fake(**conf, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y" and shared_dir(Fake(**{"spark.master": "local[2]"})).startswith("file:")


def stage_docs(spark):
    long = words(3000, 9) + " token=abcdefgh1 " + "é" * 5000
    rows = [(1, words(50, 1), "en", "a", 5), (1, words(50, 1), "en", "a", 5), (None, words(50, 1), None, None, None), (2, None, "en", "a", None), (3, "", "de", "b", 0), (4, long, "fr", "b", 9), (5, words(50, 1) + " x", "en", "a", 7), (6, "key password=hunter22", "en", None, 2)]
    return spark.createDataFrame([(*r, "kept", i) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, Score string, copy int")


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    sf, docs = "/root/testdata/sf0.001", stage_docs(spark)
    assert {name for name, _ in p.STAGES} == {"quality", "near_duplicates", "secrets", "mixing", "tokens"}
    done = {}
    for name, stage in p.STAGES:
        if name != "near_duplicates":  # the join has its own test of empty tables, and takes long
            assert stage(spark, docs.limit(0), sf).count() == 0, name
        done[name] = stage(spark, docs, sf)
        if name != "tokens":
            assert done[name].columns == docs.columns
    assert sorted(r["copy"] for r in done["near_duplicates"].collect()) == [0, 1, 2, 3, 4, 5, 7]
    clean = {r["copy"]: r for r in done["secrets"].collect()}
    assert len(clean) == 8 and clean[3]["text"] is None and clean[4]["text"] == "" and clean[7]["text"] == "key [SECRET]" and clean[7]["n_chars"] == len("key [SECRET]")
    assert "[SECRET]" in clean[5]["text"] and clean[0]["text"] == words(50, 1)
    mixed = Counter(r["copy"] for r in done["mixing"].collect())
    assert mixed[0] == mixed[1]
    told = {r["doc_id"]: r for r in done["tokens"].collect()}
    assert told[2]["n_tokens"] == told[3]["n_tokens"] == 0 and told[4]["n_tokens"] > 3000
    judged = done["quality"]
    assert judged.count() <= 8 and judged.filter("Score <> 'kept'").count() == 0
