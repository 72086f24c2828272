"""WARC derivatives: responses become linked metadata and plain-text conversion records.

A response record carries an id, a target, a date, its own headers and the HTTP message. For each, two records are built:
a metadata record (JSON: HTTP status and headers, title, links, the source record's headers and digests) and a
conversion record (the page's text). Both refer to the response by WARC-Refers-To and keep its target and date; both
have ids that follow from the response's id, so a repeated task writes the same records. Digests are sha1 in base 32, as
WARC files write them. Headers are lists of names and values in their order, so repeated ones stay.

A page is read by one scanner that goes forward only: from each "<" to the ">" that ends the tag, past quoted values, past
comments and past the content of scripts and the like. Its time grows with the page, whatever stands in it.

Files are read by a data source: a stream for each file, a record at a time, so memory follows the largest record.

Defined results: a null or empty payload gives a metadata record without title and links, and an empty conversion; a
null url gives a record without WARC-Target-URI; very large payloads are handled whole, one at a time; repeated
responses give repeated derivatives; an empty table gives an empty table; other columns are not carried over. Chunked
and compressed payloads (gzip, deflate) are unpacked for text and links, as far as they can be; one that unpacks to more
than MOST_UNPACKED bytes says so in its metadata (Unpack-Error) and has no text; digests are those of the payload as it
came. Text is decoded by the charset of the Content-Type header, else of a meta element of the page's head, else as
UTF-8; unknown charsets count as UTF-8. In files, records with a damaged length are skipped up to the next record, and
after a damaged gzip member reading goes on at the next sound one.
"""

from __future__ import annotations

import base64
import hashlib
import html as html_lib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.sources.archive import BATCH_BYTES, Archives, ArchiveReader, ArchiveSource

HEADERS = "array<struct<name:string,value:string>>"
RESPONSES = f"record_id string, target_uri string, warc_date string, headers {HEADERS}, http_status int, http_headers {HEADERS}, payload binary"
DERIVED = (
    "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, "
    f"source_headers {HEADERS}, source_payload_digest string, block_digest string, content_length long, n_links int, title string, block binary"
)
FIELDS = [x.strip().split(" ")[0] for x in DERIVED.split(", ")]
#: A payload that unpacks to more gives an error in place of text.
MOST_UNPACKED = 1 << 30
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

#: Elements whose content is no text, that begin a line, and that link.
SILENT = {"script", "style", "noscript", "template"}
BREAKING = set(
    "p div br li ul ol h1 h2 h3 h4 h5 h6 tr table article section header footer nav title body head html blockquote pre dl dt dd form aside main hr option figure".split()
)
LINKING = {"a", "link", "img", "script", "iframe", "form"}
NAME = re.compile(r"[A-Za-z][A-Za-z0-9]*")
TARGETS = {"href", "src", "action"}
#: A tag to its end: quoted values are passed over, also where they hold a ">".
TAG = re.compile(r"""(?:[^>=]++|=\s*"[^"]*"|=\s*'[^']*'|=)*+>""")
TARGET = re.compile(r"""\s(href|src|action)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in (*sorted(SILENT), "title")}
CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9._:-]+)""", re.I)
META, BODY = re.compile(rb"<meta\b[^>]*", re.I), re.compile(rb"</head\b|<body\b", re.I)
#: Bytes of a file that are read at a time, and of a damaged gzip member that are searched for the next one.
CHUNK, RESCAN = 1 << 18, 16 << 20
BLANKS, LINES = re.compile(r"[ \t\r\f\v ]+"), re.compile(r" ?\n[ \n]*")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{record_id}|{kind}')}>"


def closed(page: str, lo: int, hi: int) -> bool:
    """Whether a stretch of a tag surely ends outside of quotes: it has them of one kind at most, in pairs."""
    double, single = page.count('"', lo, hi), page.count("'", lo, hi)
    return not (double % 2 or single % 2 or (double and single))


def scan(page: str) -> tuple[str, str | None, list[tuple[str, str, str]]]:
    """The text of a page with a line break for each block element, its raw title, and (element, attribute, value) of links."""
    text, title, links = [], None, []
    at, titled, kept = 0, False, 0

    def keep(upto: int, mark: str) -> None:
        text.append(page[kept:upto].replace("\n", " "))
        text.append(mark)

    while (i := page.find("<", at)) >= 0:
        follows = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            keep(i, " ")
            at = kept = len(page) if end < 0 else end + 3
            continue
        closing = follows == "/"
        name = NAME.match(page, i + 1 + closing)
        if not name and follows not in ("!", "?"):
            at = i + 1
            continue
        at = page.find(">", i + 1) + 1
        if name and (not at or not closed(page, name.end(), at)):
            whole = TAG.match(page, name.end())
            at = whole.end() if whole else at
        if not at:
            break
        tag = name[0].lower() if name else ""
        if not closing and tag in LINKING and (found := TARGET.search(page, name.end(), at - 1)):
            if not closed(page, name.end(), found.start()):  # perhaps within the value of another attribute
                found = next((a for a in ATTRIBUTE.finditer(page, name.end(), at - 1) if a[2] and a[1].lower() in TARGETS), None)
            if found:
                links.append((tag, found[1].lower(), found[2]))
        if not closing and tag == "title" and not titled:
            titled = True
            if close := CLOSING["title"].search(page, at):
                title = page[at : close.start()]
        if not closing and tag in SILENT:
            close = CLOSING[tag].search(page, at)
            at = close.end() if close else len(page)
            keep(i, " ")
        else:
            keep(i, "\n" if tag in BREAKING else "")
        kept = at
    keep(len(page), "")
    return "".join(text), title, links


def tidy(s: str) -> str:
    """Entities resolved, blanks and line breaks in runs of one."""
    if "&" in s:
        s = html_lib.unescape(s)
    return LINES.sub("\n", BLANKS.sub(" ", s)).strip()


def page_links(found: list[tuple[str, str, str]], base: str | None) -> list[dict[str, str]]:
    out = []
    for tag, name, value in found:
        url = html_lib.unescape(value.strip("\"'")).strip()
        try:
            url = urljoin(base, url) if base else url
        except ValueError:
            pass
        out.append({"path": f"{tag.upper()}@/{name}", "url": url})
    return out


Pairs = list[tuple[str, str]]


def pairs_of(headers) -> Pairs:
    """A column of headers as a list of pairs."""
    return [(h["name"], h["value"]) if isinstance(h, dict) else tuple(h) for h in headers or ()]


def value_of(headers: Pairs, name: str) -> str:
    return next((v or "" for k, v in headers if (k or "").lower() == name.lower()), "")


def as_json(headers: Pairs) -> dict:
    """Names to values; a name that repeats has the list of them."""
    out: dict = {}
    for k, v in headers:
        out.setdefault(k, []).append(v)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def unchunked(data: bytes) -> bytes:
    """A body in chunks as one; raises ValueError where it is none."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("a chunk beyond the end")
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def unpacked(payload: bytes, http: Pairs, most: int = MOST_UNPACKED) -> tuple[bytes, str | None]:
    """The payload without transfer and content encodings, as far as they can be undone, and what is wrong where they unpack to
    more than `most` bytes."""
    try:
        if "chunked" in value_of(http, "Transfer-Encoding").lower():
            payload = unchunked(payload)
    except ValueError:
        pass  # some archives store the body without its chunks
    coding = value_of(http, "Content-Encoding").lower().strip()
    for bits in {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ()):
        try:
            unpack = zlib.decompressobj(bits)
            out = unpack.decompress(payload, most)
            return (b"", f"unpacks to more than {most} bytes") if unpack.unconsumed_tail else (out, None)
        except zlib.error:
            continue
    return payload, None


def decoded(data: bytes, http: Pairs) -> str:
    found = CHARSET.search(value_of(http, "Content-Type"))
    if not found:
        end = BODY.search(data)
        named = (CHARSET.search(m[0].decode("latin-1")) for m in META.finditer(data, 0, end.start() if end else len(data)))
        found = next((f for f in named if f), None)
    try:
        return data.decode(found[1] if found else "utf-8", errors="replace")
    except (LookupError, UnicodeError, ValueError):
        return data.decode("utf-8", errors="replace")


def derivatives(r: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload = bytes(r["payload"] or b"")
    headers, http = pairs_of(r["headers"]), pairs_of(r["http_headers"])
    page, wrong = unpacked(payload, http)
    text, title, found = scan(decoded(page, http))
    title = None if title is None else BLANKS.sub(" ", html_lib.unescape(title).replace("\n", " ")).strip()
    links = page_links(found, r["target_uri"])
    of_source = digest(payload)
    envelope = {
        "Envelope": {
            "WARC-Header-Metadata": as_json(headers),
            "Payload-Metadata": {
                "HTTP-Response-Metadata": {
                    "Response-Message": {"Status": r["http_status"]},
                    "Headers": as_json(http),
                    "Entity-Length": len(payload),
                    "Entity-Digest": of_source,
                    "HTML-Metadata": {"Head": {"Title": title}, "Links": links},
                }
            },
        }
    }
    if wrong:
        envelope["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Unpack-Error"] = wrong
    as_stored = json.dumps(envelope, ensure_ascii=False, sort_keys=True).encode(errors="replace")
    blocks = [("metadata", "application/json", as_stored), ("conversion", "text/plain", tidy(text).encode(errors="replace"))]
    return [
        {
            "record_id": derived_id(r["record_id"], kind),
            "warc_type": kind,
            "refers_to": r["record_id"],
            "target_uri": r["target_uri"],
            "warc_date": r["warc_date"],
            "content_type": content,
            "source_headers": [{"name": k, "value": v} for k, v in headers],
            "source_payload_digest": of_source,
            "block_digest": digest(block),
            "content_length": len(block),
            "n_links": len(links),
            "title": title,
            "block": block,
        }
        for kind, content, block in blocks
    ]


LIST = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
ARROW = pa.schema(
    [(f, LIST if f == "source_headers" else pa.int64() if f == "content_length" else pa.int32() if f == "n_links" else pa.binary() if f == "block" else pa.string()) for f in FIELDS]
)


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two records for each response, in the columns of DERIVED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                made = derivatives(r)
                rows += made
                size += sum(x["content_length"] for x in made)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, size = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    names = [x.strip().split(" ")[0] for x in RESPONSES.split(", ")]
    return responses.select(*names).mapInArrow(run, DERIVED)


def parse_http(message: bytes) -> tuple[int | None, Pairs, bytes]:
    head, _, body = message.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    status = re.match(r"HTTP/\S+ (\d{3})", lines[0])
    headers = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if k.strip()]
    return (int(status[1]) if status else None), headers, body


class Damaged(Exception):
    """What is being read breaks off; reading may go on behind it."""


class Unzipped:
    """The content of gzip members one after another, read forward. Where a member is damaged, what was read of it and not yet
    taken is dropped, Damaged is raised once, and the next read goes on at the next member."""

    def __init__(self, raw, head: bytes = b""):
        self.raw, self.packed, self.out, self.unzip, self.tried = raw, head, bytearray(), None, bytearray()

    def _begin(self) -> bool:
        while (i := self.packed.find(b"\x1f\x8b\x08")) < 0:
            more = self.raw.read(CHUNK)
            if not more:
                return False
            self.packed = self.packed[-2:] + more
        self.packed, self.unzip, self.tried = self.packed[i:], zlib.decompressobj(31), bytearray()
        return True

    def _more(self) -> bool:
        if self.unzip is None and not self._begin():
            return False
        data, self.packed = self.packed or self.raw.read(CHUNK), b""
        self.tried += data
        del self.tried[:-RESCAN]
        try:
            if not data:
                raise zlib.error("cut off")
            self.out += self.unzip.decompress(data)
        except zlib.error as e:
            self.packed, self.unzip, self.out = bytes(self.tried[1:]), None, bytearray()
            raise Damaged from e
        if self.unzip.eof:
            self.packed, self.unzip = self.unzip.unused_data, None
        return True

    def _take(self, n: int) -> bytes:
        out = bytes(self.out[:n])
        del self.out[:n]
        return out

    def read(self, n: int) -> bytes:
        while len(self.out) < n and self._more():
            pass
        return self._take(n)

    def readline(self) -> bytes:
        seen = 0
        while (end := self.out.find(b"\n", seen)) < 0:
            seen = len(self.out)
            if not self._more():
                return self._take(seen)
        return self._take(end + 1)


def read_records(stream) -> Iterator[tuple[Pairs, bytes]]:
    """Headers and block of each record of a WARC stream, one at a time; the stream may be several gzip members."""
    line = None
    while line != b"":
        try:
            line = stream.readline()
            while line.startswith(b"WARC/"):
                headers: Pairs = []
                while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                    k, _, v = line.decode("utf-8", errors="replace").partition(":")
                    headers.append((k.strip(), v.strip()))
                size = value_of(headers, "Content-Length") or "0"
                if size.isdecimal():
                    block = stream.read(int(size))
                    if len(block) == int(size):
                        yield headers, block
                line = stream.readline()
        except Damaged:
            line = None


class _Plain:
    """A stream with lines, and the bytes that were read ahead of it."""

    def __init__(self, raw, head: bytes):
        self.raw, self.out = raw, bytearray(head)

    def _more(self) -> bool:
        more = self.raw.read(CHUNK)
        self.out += more
        return bool(more)

    _take, read, readline = Unzipped._take, Unzipped.read, Unzipped.readline


def opened(raw):
    """A WARC file's bytes, unzipped if they are gzip members."""
    head = raw.read(2)
    return Unzipped(raw, head) if head == b"\x1f\x8b" else _Plain(raw, head)


RESPONSE_ARROW = pa.schema([("record_id", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("headers", LIST), ("http_status", pa.int32()), ("http_headers", LIST), ("payload", pa.binary())])


def responses(raw) -> Iterator[pa.RecordBatch]:
    """The responses of one WARC file, in batches of about BATCH_BYTES."""
    rows, held = [], 0
    for headers, block in read_records(opened(raw)):
        if value_of(headers, "WARC-Type") != "response":
            continue
        status, http, body = parse_http(block)
        named = [[{"name": k, "value": v} for k, v in pairs] for pairs in (headers, http)]
        of = lambda name: value_of(headers, name) or None  # noqa: B023, E731
        rows.append({"record_id": of("WARC-Record-ID"), "target_uri": of("WARC-Target-URI"), "warc_date": of("WARC-Date"), "headers": named[0], "http_status": status, "http_headers": named[1], "payload": body})
        held += len(block)
        if held > BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=RESPONSE_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=RESPONSE_ARROW)


class WarcReader(ArchiveReader):
    ENDINGS = (".warc", ".warc.gz")

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = self._at()
        for path, _ in partition.files:
            with files.open_input_stream(path, compression=None) as raw:
                yield from responses(raw)


class WarcSource(ArchiveSource):
    """spark.read.format("warc").load(path): the responses of all WARC files below a path, in the columns of RESPONSES, each file
    as a stream. Option: partition_bytes (0: a partition for each file)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RESPONSES

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").load(path)


def parse_warc(files: DataFrame) -> DataFrame:
    """Responses of WARC files that a table holds (column content), for stores that only Spark's own readers open; a file of at
    most 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                if value.is_valid:
                    yield from responses(pa.BufferReader(value.as_buffer()))

    return files.select("content").mapInArrow(run, RESPONSES)


#: Header names of a derived record, and the columns that hold their values.
RECORD_HEADERS = (
    ("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Refers-To-Date", "warc_date"),
    ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    ("X-Source-Payload-Digest", "source_payload_digest"),
)
#: Before the name of each header of the source record.
SOURCE = "X-Source-"


def format_record(r: dict) -> bytes:
    """A derived record as it stands in a WARC file, with the headers and the digest of its source."""
    one = lambda v: re.sub(r"[\r\n]+", " ", str(v))
    head = [(k, r[c]) for k, c in RECORD_HEADERS] + [(SOURCE + (k or ""), v) for k, v in pairs_of(r["source_headers"])]
    lines = "".join(f"{one(k)}: {one(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + bytes(r["block"] or b"") + b"\r\n\r\n"


def with_warc_bytes(derived: DataFrame) -> DataFrame:
    """Adds warc_record: each record's bytes, ready to be concatenated into files."""
    one = lambda c: F.regexp_replace(c.cast("string"), r"[\r\n]+", " ")
    own = F.array(*[F.concat(F.lit(f"{k}: "), one(F.col(c))) for k, c in RECORD_HEADERS])
    sources = F.transform("source_headers", lambda h: F.concat(F.lit(SOURCE), one(F.coalesce(h["name"], F.lit(""))), F.lit(": "), one(h["value"])))
    lines = F.array_join(F.concat(F.array(F.lit("WARC/1.1")), own, F.coalesce(sources, F.array().cast("array<string>"))), "\r\n")  # headers without value are null and go
    return derived.withColumn("warc_record", F.concat(F.concat(lines, F.lit("\r\n\r\n")).cast("binary"), F.coalesce("block", F.lit(b"")), F.lit(b"\r\n\r\n")))


def responses_of_pages(pages: DataFrame) -> DataFrame:
    """Crawled pages (page_id, url, html) as response records with ids that follow from page_id and url."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("null"))))
    rid = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(key, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    payload = F.col("html").cast("binary")
    date = F.lit("2024-01-01T00:00:00Z")
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("string")
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.array(
        pair("WARC-Type", F.lit("response")), pair("WARC-Record-ID", rid), pair("WARC-Date", date),
        pair("WARC-Target-URI", F.coalesce("url", F.lit(""))), pair("Content-Length", size),
    )
    http = F.array(pair("Content-Type", F.lit("text/html; charset=utf-8")), pair("Content-Length", size))
    return pages.select(
        rid.alias("record_id"), F.col("url").alias("target_uri"), date.alias("warc_date"), headers.alias("headers"),
        F.lit(200).alias("http_status"), http.alias("http_headers"), payload.alias("payload"),
    )


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return build_derivatives(responses_of_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
