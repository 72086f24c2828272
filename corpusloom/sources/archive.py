"""Repository archives (tar, gzipped or not) and folders as tables of files, read where Spark can read.

`ArchiveSource` is a Python data source: its planner lists archives, its readers stream them. A reader goes through a tar
once, forward, and gives entries as it meets them, in batches of bounded size; of an entry it holds `max_read` bytes and
drains the rest, and of the archive nothing. What an archive may not be (too large, damaged, gone) is a row with an error
code at the end of what could be read of it, so no archive stops another.
"""

from __future__ import annotations

import gzip
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRIES = "repo_id string, seq long, path string, size long, bytes binary, error string"
SCHEMA = pa.schema([("repo_id", pa.string()), ("seq", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("bytes", pa.binary()), ("error", pa.string())])
ENDINGS = (".tar.gz", ".tgz", ".tar", ".gz")
MAX_INFLATED, MAX_ENTRIES, MAX_READ = 1_500_000_000, 200_000, 160_001
MAX_ARCHIVE = 150 * 1024 * 1024
#: Bytes of entries in a batch, and of small archives that one partition reads in turn.
BATCH_BYTES, PARTITION_BYTES = 4 << 20, 64 << 20
#: Files that hold rules, which are read whole up to RULE_BYTES; larger ones are not used.
RULE_FILES, RULE_BYTES = (".gitignore", ".gitattributes"), 200_000
#: Manifests above a chosen folder that still shape how it is read.
CONTEXT_MANIFESTS = "package.json tsconfig.json jsconfig.json go.mod pyproject.toml composer.json pubspec.yaml".split()


class ArchiveFailed(Exception):
    """An archive that cannot be read on, with its code: too_large, unreadable, unreachable."""


@dataclass(frozen=True)
class Limits:
    """What is read of an archive. max_archive and max_inflated are bytes, max_read is bytes of one entry."""

    max_read: int = MAX_READ
    max_archive: int = MAX_ARCHIVE
    max_inflated: int = MAX_INFLATED
    max_entries: int = MAX_ENTRIES

    @classmethod
    def of(cls, options) -> Limits:
        return cls(**{name: int(options[name]) for name in cls.__dataclass_fields__ if options.get(name) is not None})


class _Counted:
    """A file that fails as too large once it has given more bytes than allowed."""

    def __init__(self, inner, most: int):
        self.inner, self.left = inner, most

    def read(self, n: int = -1) -> bytes:
        data = self.inner.read(n if n is not None and n >= 0 else BATCH_BYTES)
        self.left -= len(data)
        if self.left < 0:
            raise ArchiveFailed("too_large")
        return data


def _inflated(stream, limits: Limits) -> _Counted:
    packed = _Counted(stream, limits.max_archive)
    head = b""
    while len(head) < 2 and (more := packed.read(2 - len(head))):
        head += more
    whole = _Resumed(head, packed)
    return _Counted(gzip.GzipFile(fileobj=whole, mode="rb") if head == b"\x1f\x8b" else whole, limits.max_inflated)


class _Resumed:
    """A stream with the bytes that were read ahead of it."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def read(self, n: int = -1) -> bytes:
        if not self.head:
            return self.rest.read(n)
        out, self.head = (self.head, b"") if n is None or n < 0 else (self.head[:n], self.head[n:])
        return out


def entries(stream, limits: Limits = Limits()) -> Iterator[tuple[str, int, bytes]]:
    """(path without its first folder, size, at most max_read bytes) of each file of a tar, in its order.

    Rule files are read up to RULE_BYTES whatever max_read says. Raises ArchiveFailed."""
    try:
        with tarfile.open(fileobj=_inflated(stream, limits), mode="r|", bufsize=1 << 18) as tar:
            n = 0
            for member in tar:
                tar.members = []  # the module keeps every header it has read
                path = member.name.split("/", 1)[1] if "/" in member.name else ""
                if not member.isfile() or not path:
                    continue
                base = path.rsplit("/", 1)[-1]
                n += base not in RULE_FILES
                if n > limits.max_entries:
                    raise ArchiveFailed("too_large")
                handle = tar.extractfile(member)
                most = max(limits.max_read, RULE_BYTES) if base in (*RULE_FILES, *CONTEXT_MANIFESTS) else limits.max_read
                yield path, member.size, handle.read(most) if handle else b""
    except (tarfile.TarError, EOFError, zlib.error, gzip.BadGzipFile) as e:
        raise ArchiveFailed("unreadable") from e
    except OSError as e:
        raise ArchiveFailed("unreachable") from e


def _batches(repo: str, open_stream, limits: Limits) -> Iterator[pa.RecordBatch]:
    """The rows of one archive. open_stream gives a context manager of a readable file."""
    rows: list[tuple] = []
    held, seq = 0, 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    try:
        try:
            with open_stream() as stream:
                for path, size, body in entries(stream, limits):
                    rows.append((repo, seq, path, size, body, None))
                    seq, held = seq + 1, held + len(body) + 200
                    if held > BATCH_BYTES:
                        yield batch()
                        rows, held = [], 0
        except OSError as e:
            raise ArchiveFailed("unreachable") from e
    except ArchiveFailed as e:
        rows.append((repo, -1, None, None, None, str(e)))
    if rows:
        yield batch()


def repo_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return next((name[: -len(end)] for end in ENDINGS if name.endswith(end)), name)


@dataclass
class Archives(InputPartition):
    """Archives that one task reads in turn: a large one alone, small ones together. (path, length) of each."""

    files: tuple[tuple[str, int], ...]


class ArchiveReader(DataSourceReader):
    ENDINGS = ENDINGS

    def __init__(self, options):
        self.path, self.limits = options["path"], Limits.of(options)
        self.together = int(options.get("partition_bytes", PARTITION_BYTES))

    def _at(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path.replace("file:/", "file:///", 1) if self.path.startswith("file:/") and not self.path.startswith("file://") else self.path)
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[Archives]:
        from pyarrow import fs

        files, root = self._at()
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        listed = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out: list[Archives] = []
        some: list[tuple[str, int]] = []
        for f in sorted((x for x in listed if x.type == fs.FileType.File and x.path.endswith(self.ENDINGS)), key=lambda x: x.path):
            if some and sum(size for _, size in some) + f.size > self.together:
                out.append(Archives(tuple(some)))
                some = []
            some.append((f.path, f.size))
        return [*out, Archives(tuple(some))] if some else out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = self._at()
        for path, length in partition.files:
            if length > self.limits.max_archive:  # what is declared too large is not opened
                yield from _batches(repo_of(path), _too_large, self.limits)
            else:
                yield from _batches(repo_of(path), lambda p=path: files.open_input_stream(p, compression=None), self.limits)


def _too_large():
    raise ArchiveFailed("too_large")


class ArchiveSource(DataSource):
    """spark.read.format("archives").load(path): ENTRIES rows of the archives below a path of a file system that pyarrow opens.

    Options: max_read, max_archive, max_inflated, max_entries, partition_bytes (0: a partition for each archive)."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **limits: int) -> DataFrame:
    """The entries of all archives under a path; see ArchiveSource for limits."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archives").options(**limits).load(path)


class _Cell:
    """The bytes of a cell as a file."""

    def __init__(self, data: pa.Scalar):
        self.data = pa.BufferReader(data.as_buffer() if data.is_valid else b"")

    def __enter__(self):
        return self.data

    def __exit__(self, *_):
        self.data.close()


def read_entries(archives: DataFrame, **limits: int) -> DataFrame:
    """Archives that a table holds (repo_id, content), as ENTRIES rows; for stores that only Spark's own readers open."""
    bound = Limits(**limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for repo, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from _batches(repo, lambda c=content: _Cell(c), bound)

    return archives.select("repo_id", "content").mapInArrow(run, ENTRIES)


def archive_errors(rows: DataFrame) -> DataFrame:
    """(repo_id, stage, code) of the archives that could not be read to their end."""
    return rows.filter("error IS NOT NULL").select("repo_id", F.lit("archive").alias("stage"), F.col("error").alias("code"))


def fetch_error(status: Column, remaining: Column, retry_after: Column, declared: Column, with_token: Column, most: int = MAX_ARCHIVE) -> Column:
    """S3: what the answer to a request for an archive means, null where its body may be read.

    status: null where no answer came; remaining: requests left by the limit's header; retry_after and declared (length) as
    sent, null where absent; with_token: whether the server's own token was used."""
    limited = (status == 403) & ((remaining == "0") | retry_after.isNotNull())
    return (
        F.when(status.isNull(), "unreachable")
        .when(with_token & (status == 401), "misconfigured")
        .when(F.coalesce((status == 429) | limited, F.lit(False)), "rate_limited")
        .when(status.isin(401, 403, 404), "not_found")
        .when(~status.between(200, 299), "unreachable")
        .when(F.coalesce(declared, F.lit(0)) > most, "too_large")
    )


def inside(files: DataFrame, subpath: str) -> DataFrame:
    """The files below a folder, with paths from there."""
    prefix = subpath.strip("/") + "/" if subpath.strip("/") else ""
    return files.filter(F.startswith("path", F.lit(prefix))).withColumn("path", F.substring("path", len(prefix) + 1, 2**31 - 1))


def context_manifests(files: DataFrame, subpath: str, most: int = 200_000) -> DataFrame:
    """Manifests in the folders above subpath."""
    parts = [p for p in subpath.split("/") if p]
    above = ["/".join(parts[:i]) for i in range(len(parts))]
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit(""))
    return files.filter(F.substring_index("path", "/", -1).isin(CONTEXT_MANIFESTS) & folder.isin(above) & (F.col("size") < most))
