"""WARC files as streams: damage, quoted values, charsets, bounds, and the bytes of derived records; op4's groups of long texts."""

from __future__ import annotations

import gzip
import io
import json
import random
import zlib

import pyarrow as pa
import pytest
from corpusloom.llm import jaccard_join, textgrams, warc


def record(k, body=b"<p>", kind=b"response") -> bytes:
    http = b"HTTP/1.1 200 OK\r\n\r\n" + body + str(k).encode()
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, k, len(http), http)


def ids(data: bytes) -> list[str]:
    return [warc.value_of(h, "WARC-Record-ID") for h, _ in warc.read_records(warc.opened(io.BytesIO(data)))]


def test_reading_goes_on_after_a_damaged_member():
    big = random.Random(1).randbytes(400_000)
    members = [gzip.compress(record(k, big if k == 2 else b"x" * k)) for k in range(6)]
    assert ids(b"".join(members)) == [f"<{k}>" for k in range(6)]
    hurt = bytearray(members[2])
    hurt[len(hurt) // 2 : len(hurt) // 2 + 40] = b"\0" * 40
    assert ids(b"".join([*members[:2], bytes(hurt), *members[3:]])) == ["<0>", "<1>", "<3>", "<4>", "<5>"]
    assert ids(b"".join([*members[:2], members[2][:1000], *members[3:]])) == ["<0>", "<1>", "<3>", "<4>", "<5>"]
    assert ids(b"".join([*members[:3], b"\x1f\x8b\x08rubbish", *members[3:]])) == [f"<{k}>" for k in range(6)]
    assert ids(b"".join(members)[:-9]) == [f"<{k}>" for k in range(5)] or ids(b"".join(members)[:-9])[:5] == [f"<{k}>" for k in range(5)]
    assert ids(gzip.compress(b"".join(record(k) for k in range(50)))) == [f"<{k}>" for k in range(50)]
    assert ids(b"") == ids(b"\x1f\x8b") == ids(gzip.compress(b"")) == []


def test_files_as_a_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.warc").write_bytes(record(1) + record(2, kind=b"request") + record(3))
    (tmp_path / "sub" / "b.warc.gz").write_bytes(gzip.compress(record(4)) + gzip.compress(record(5) * 9)[:-30] + gzip.compress(record(6)))
    (tmp_path / "other.gz").write_bytes(gzip.compress(record(9)))
    got = {r["record_id"] for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {"<1>", "<3>", "<4>", "<6>"} <= got <= {"<1>", "<3>", "<4>", "<5>", "<6>"}
    cells = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(str(tmp_path))
    rows = lambda df: sorted((r["record_id"], bytes(r["payload"]), r["http_status"], str(r["headers"])) for r in df.collect())
    assert rows(warc.parse_warc(cells)) == rows(warc.read_warc(spark, str(tmp_path)))


def test_memory_follows_the_record_not_the_file(tmp_path):
    """A stream of 600 MB of records, of which none is held for long."""

    class Endless:
        def __init__(self, total):
            self.left, self.one = total, gzip.compress(record(1, b"y" * 1_000_000))

        def read(self, n):
            self.left -= 1
            return self.one if self.left >= 0 else b""

    import tracemalloc

    tracemalloc.start()
    count = sum(1 for _ in warc.read_records(warc.Unzipped(Endless(600))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 600 and peak < 30_000_000


@pytest.mark.parametrize(
    ("page", "text", "links"),
    [
        ('<p>x <a title="a > b" href="/z">t</a>', "x t", [("a", "href", '"/z"')]),
        ("<p>x <a title='a > b' href=/z>t</a>", "x t", [("a", "href", "/z")]),
        ('<a title="see href=no" href="/yes">t', "t", [("a", "href", '"/yes"')]),
        ('<a title="open>t</a> more', "t more", []),
        ("<p don't>it's <img alt='1 > 0' src=a.png>fine", "it's fine", [("img", "src", "a.png")]),
        ('<a data-href="/no" HREF = "/x">t', "t", [("a", "href", '"/x"')]),
        ("<a href>t<a href=''>u", "tu", [("a", "href", "''")]),
    ],
)
def test_quoted_values(page, text, links):
    got = warc.scan(page)
    assert warc.tidy(got[0]) == text and got[2] == links


def test_charsets_anywhere_in_the_head():
    far = b"<head>" + b"<!-- filler -->" * 200 + b'<meta charset="latin-1"></head><body><p>\xe9'
    assert warc.tidy(warc.scan(warc.decoded(far, []))[0]) == "é"
    talk = "<head></head><body><p>é <meta charset=latin-1>".encode()
    assert warc.tidy(warc.scan(warc.decoded(talk, []))[0]) == "é"
    assert warc.decoded("charset=latin-1 é".encode(), []) == "charset=latin-1 é"
    assert warc.decoded(far, [("Content-Type", "text/html; charset=cp1252")]).endswith("é")


def test_what_unpacks_to_too_much_is_an_error_in_its_metadata(monkeypatch):
    base = {"record_id": "r", "target_uri": "http://x.org/", "warc_date": None, "headers": [], "http_status": 200, "http_headers": [("Content-Encoding", "gzip")]}
    monkeypatch.setattr(warc.unpacked, "__defaults__", (1000,))
    meta, text = warc.derivatives(base | {"payload": gzip.compress(b"<p>" + b"a" * 5000)})
    assert text["block"] == b"" and meta["title"] is None and meta["n_links"] == 0
    assert json.loads(meta["block"])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Unpack-Error"] == "unpacks to more than 1000 bytes"
    meta, text = warc.derivatives(base | {"payload": gzip.compress(b"<p>" + b"a" * 500)})
    assert len(text["block"]) == 500 and b"Unpack-Error" not in meta["block"]
    assert zlib.crc32(text["block"])


def test_derived_bytes_keep_source_headers_and_digest(spark):
    headers = [("WARC-Type", "response"), ("X-Odd", "a\r\nb"), ("Empty", None), ("X-Odd", "again")]
    rows = [("<r>", "http://x.org/é", "2024-01-01T00:00:00Z", headers, 200, [("Content-Type", "text/html")], b"<p>hi"), (None, None, None, None, None, None, None)]
    out = warc.with_warc_bytes(warc.build_derivatives(spark.createDataFrame(rows, warc.RESPONSES))).collect()
    assert len(out) == 4
    for r in out:
        assert bytes(r["warc_record"]) == warc.format_record(r.asDict(recursive=True))
        head, block = next(warc.read_records(warc.opened(io.BytesIO(bytes(r["warc_record"])))))
        assert block == bytes(r["block"]) and warc.value_of(head, "X-Source-Payload-Digest") == r["source_payload_digest"]
        if r["refers_to"]:
            assert [v for k, v in head if k == "X-Source-X-Odd"] == ["a b", "again"] and warc.value_of(head, "WARC-Refers-To-Target-URI") == "http://x.org/é"


def test_groups_of_long_texts_stream_past(monkeypatch):
    """A group of long near copies, in batches that cut it anywhere: few sets are held at a time, and every link is found."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(5000)}" for _ in range(4000)]
    texts = []
    for k in range(40):
        own = list(words)
        for _ in range(20):
            own[rng.randrange(len(own))] = f"x{k}"
        texts.append(" ".join(own))
    sets = [s for _, s in jaccard_join.shingle_sets(pa.array(texts), 5)]
    names = [int(jaccard_join.set_name(s)) for s in sets]
    rows = [(7, k == 0, names[k], texts[k]) for k in range(40)] + [(8, True, 1, texts[0]), (8, True, names[1], texts[1]), (8, False, names[2], texts[2]), (9, False, names[3], texts[3])]
    want = {(names[0], names[k]) for k in range(1, 40)} | {(names[1], names[2])}
    most: list[int] = []
    real = jaccard_join.t_occurrence
    monkeypatch.setattr(jaccard_join, "t_occurrence", lambda query, some, percent: most.append(len(some)) or real(query, some, percent))
    for cut in (1, 7, 100):
        for size in (60_000, 2 << 20):
            monkeypatch.setattr(textgrams, "SLICE", size)
            most.clear()
            batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + cut], strict=True), (pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)], names=["g", "q", "c", "t"]) for at in range(0, len(rows), cut)]
            got = {(r["a"], r["b"]) for b in jaccard_join._search(5, 80)(iter(batches)) for r in b.to_pylist()}
            assert got == want and max(most) <= (3 if size == 60_000 else cut)
