"""Data sources for Spark's reader and writer: archives, Office files and judgments, with planned partitions and pushed filters.

They read through Arrow's file systems (local paths, file://, s3://, gs://, hdfs://), on executors. For paths
that only Spark's own readers know, load `binaryFile` and use `parsers.parse_files`.
"""

from __future__ import annotations

import io
import json
import operator
import tarfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D

from tessera.runtime import ship
from tessera.sources import office

PARTITION_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
MOST_BYTES = (1 << 31) - 64
ARCHIVES = (".zip", ".tar", ".tar.gz", ".tgz")

_TESTS = {
    "EqualTo": operator.eq, "In": lambda v, of: v in of, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt,
    "LessThanOrEqual": operator.le, "StringStartsWith": str.startswith, "StringEndsWith": str.endswith, "StringContains": operator.contains,
}


def listed(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below a place, in order; hidden ones aside, as Spark has it."""
    fs, root = pafs.FileSystem.from_uri(uri)
    info = fs.get_file_info(root)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
    within = lambda p: [x for x in p[len(root) :].split("/") if x] or [p.rsplit("/", 1)[-1]]
    kept = [f for f in found if f.is_file and f.path.lower().endswith(suffixes) and not any(x.startswith(("_", ".")) for x in within(f.path))]
    return sorted((f.path, f.size) for f in kept)


def _plain(options) -> dict:
    """Options by lower-case names, as Spark has them."""
    return {k.lower(): v for k, v in options.items()}


@dataclass
class Files(D.InputPartition):
    paths: list[str]


@dataclass
class Span(D.InputPartition):
    path: str
    start: int
    end: int


def packed(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in partitions of up to `most` bytes, or one file that is larger."""
    out, held = [], most + 1
    for path, size in files:
        if held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


class Reader(D.DataSourceReader):
    """A reader that tests filters on some of its columns itself, and leaves the others to Spark."""

    tested: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()

    def __init__(self, options: dict):
        options = _plain(options)
        self.uri = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = type(f).__name__
            if name in _TESTS and len(f.attribute) == 1 and f.attribute[0] in self.tested:
                self.filters.append((f.attribute[0], name, f.value))
            else:
                yield f

    def passes(self, **values) -> bool:
        """Whether the values that are known pass all filters on them; a null passes none."""
        return all(values[c] is not None and _TESTS[t](values[c], of) for c, t, of in self.filters if c in values)

    def partitions(self):
        files = [(p, n) for p, n in listed(self.uri, self.suffixes) if self.passes(path=p)]
        return packed(files, self.most) or [Files([])]

    def opened(self, path: str):
        return pafs.FileSystem.from_uri(self.uri)[0].open_input_file(path)


def batched(rows: Iterator[dict], schema: pa.Schema, weigh: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of up to 4,096 rows and about 8 MB."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get(weigh) or b"") if weigh else 0
        if len(held) == 4096 or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


# --- archives ----------------------------------------------------------------------------------

_MEMBERS = pa.schema([("path", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])


class ArchiveReader(Reader):
    tested = ("path", "member", "size")
    suffixes = ARCHIVES

    def __init__(self, options: dict):
        super().__init__(options)
        self.whole = str(_plain(options).get("content", "true")).lower() != "false"

    def members(self, path: str) -> Iterator[dict]:
        """A member is opened only if it passes; an archive that breaks off gives what came before, then its error."""

        def row(name: str, size: int, open_it) -> dict | None:
            if not self.passes(member=name, size=size):
                return None
            if self.whole and size > MOST_BYTES:
                return {"path": path, "member": name, "size": size, "error": "too large for a column"}
            return {"path": path, "member": name, "size": size, "content": open_it() if self.whole else None}

        try:
            with self.opened(path) as f:
                if path.lower().endswith(".zip"):
                    with zipfile.ZipFile(f) as z:
                        for i in z.infolist():
                            if not i.is_dir() and (r := row(i.filename, i.file_size, lambda i=i: z.read(i))):
                                yield r
                else:
                    with tarfile.open(fileobj=f, mode="r|*") as t:
                        for i in t:
                            if i.isfile() and (r := row(i.name, i.size, lambda i=i: t.extractfile(i).read())):
                                yield r
        except (zipfile.BadZipFile, tarfile.TarError, EOFError, OSError, ValueError, NotImplementedError, RuntimeError) as e:
            if self.passes(member=None, size=None):
                yield {"path": path, "error": f"{type(e).__name__}: {e}"}

    def read(self, partition: Files):
        yield from batched((r for p in partition.paths for r in self.members(p)), _MEMBERS, "content")


class ArchiveWriter(D.DataSourceWriter):
    """Each task writes archives of up to `archiveBytes` into a folder that readers don't see; the commit moves them into place."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are added to a folder: use mode append")
        options = _plain(options)
        self.uri = options["path"]
        self.most = int(options.get("archivebytes", 256 << 20))
        self.job = uuid.uuid4().hex

    def write(self, rows):
        fs, root = pafs.FileSystem.from_uri(self.uri)
        held = f"{root}/_temporary-{self.job}"
        fs.create_dir(held, recursive=True)
        message = Written([])
        size, z, out = 0, None, None
        for r in rows:
            if z is None or size >= self.most:
                if z is not None:
                    z.close(), out.close()
                message.names.append(f"part-{uuid.uuid4().hex}.zip")
                out = fs.open_output_stream(f"{held}/{message.names[-1]}")
                z, size = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), 0
            content = r["content"] or b""
            z.writestr(zipfile.ZipInfo(r["member"]), bytes(content), zipfile.ZIP_DEFLATED)
            size += len(content)
        if z is not None:
            z.close(), out.close()
        return message

    def commit(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.uri)
        held = f"{root}/_temporary-{self.job}"
        for m in messages:
            for name in m.names if m else []:
                fs.move(f"{held}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, root = pafs.FileSystem.from_uri(self.uri)
        held = f"{root}/_temporary-{self.job}"
        if fs.get_file_info(held).type == pafs.FileType.Directory:
            fs.delete_dir(held)


@dataclass
class Written(D.WriterCommitMessage):
    names: list[str]


class Archives(D.DataSource):
    """Members of zip and tar archives: path, member, size, content, error. Option content=false leaves the bytes out.

    Filters on path, member and size are tested before a member is unpacked. Written: rows of member and
    content, as zip archives. A damaged archive gives a row with its error.
    """

    @classmethod
    def name(cls):
        return "tessera_archive"

    def schema(self):
        return "path string, member string, size long, content binary, error string"

    def reader(self, schema):
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite):
        return ArchiveWriter(self.options, overwrite)


# --- Office files ------------------------------------------------------------------------------


class OfficeReader(Reader):
    tested = ("path",)
    suffixes = tuple(f".{s}" for s in office.PARSERS)

    def parsed(self, path: str) -> Iterator[dict]:
        try:
            with self.opened(path) as f:
                found = office.PARSERS[path.rpartition(".")[2].lower()](f.read())
            yield from ({"path": path, **s} for s in found)
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError) as e:
            yield {"path": path, "error": f"{type(e).__name__}: {e}"}

    def read(self, partition: Files):
        yield from batched((r for p in partition.paths for r in self.parsed(p)), office._ARROW)


class OfficeFiles(D.DataSource):
    """Sections of the Word, PowerPoint and Excel files of a folder, as `office.read` gives them; filters on path are tested before a file is opened."""

    @classmethod
    def name(cls):
        return "tessera_office"

    def schema(self):
        return office._SCHEMA

    def reader(self, schema):
        return OfficeReader(self.options)


# --- judgments ---------------------------------------------------------------------------------

_JUDGED = pa.schema([("query_id", pa.string()), ("doc_id", pa.string()), ("relevance", pa.int32())])
# What the columns are called.
_NAMES = {"query_id": ("query-id", "qid", "query_id"), "doc_id": ("corpus-id", "pid", "doc_id"), "relevance": ("score", "relevance")}


def _whole(value: object) -> int:
    try:
        n = int(str(value).strip())
    except ValueError:
        return 0
    return n if -(1 << 31) <= n < 1 << 31 else 0


def judgment(row: dict) -> dict:
    """A judgment of either naming; without a relevance it is 0, without an id an error."""
    text = lambda v: "" if v is None else str(v).strip()
    out: dict = {k: next((t for n in _NAMES[k] if (t := text(row.get(n)))), None) for k in ("query_id", "doc_id")}
    for k, v in out.items():
        if v is None:
            raise ValueError(f"a judgment has no {k}")
    return out | {"relevance": next((n for c in _NAMES["relevance"] if (n := _whole(row.get(c)))), 0)}


class JudgmentReader(Reader):
    tested = ("query_id", "doc_id", "relevance")
    suffixes = (".tsv", ".csv", ".jsonl", ".json")

    def partitions(self):
        spans = [Span(p, a, min(a + self.most, n)) for p, n in listed(self.uri, self.suffixes) for a in range(0, n, self.most)]
        return spans or [Span("", 0, 0)]

    def lines(self, span: Span) -> Iterator[tuple[list[str] | None, str]]:
        """(header, line) of the lines that begin within a span; lines are read one by one."""
        with self.opened(span.path) as raw, io.BufferedReader(raw) as f:
            header = None
            if not span.path.lower().endswith((".jsonl", ".json")):
                header = f.readline().decode("utf-8-sig").rstrip("\r\n").split("\t")
            body = f.tell()
            if span.start > body:
                f.seek(span.start - 1)
                f.readline()
            while f.tell() < span.end and (line := f.readline()):
                if text := line.decode("utf-8-sig").strip("\r\n"):
                    yield header, text

    def rows(self, span: Span) -> Iterator[dict]:
        for header, line in self.lines(span):
            r = judgment(dict(zip(header, line.split("\t"))) if header else json.loads(line))
            if self.passes(**r):
                yield r

    def read(self, partition: Span):
        if partition.path:
            yield from batched(self.rows(partition), _JUDGED)


class Judgments(D.DataSource):
    """query_id, doc_id, relevance of tab-separated files with a header (cells unquoted) and of JSON lines, large files in spans of bytes; filters on all columns are tested while reading."""

    @classmethod
    def name(cls):
        return "tessera_judgments"

    def schema(self):
        return "query_id string, doc_id string, relevance int"

    def reader(self, schema):
        return JudgmentReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats tessera_archive, tessera_office and tessera_judgments known to a session, and lets filters reach them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Archives, OfficeFiles, Judgments):
        spark.dataSource.register(source)
