"""Parsers by type of source, as table functions for SQL and as one function over files."""

from __future__ import annotations

import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tessera.runtime import ship
from tessera.sources import files, markdown, office, web

#: What a parser is: content and location to sections (order_index, toc_path, level, kind, section_text).
Parser = Callable[[bytes, str], Iterable[dict]]


def _title(location: str) -> str:
    return location.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _markdown(content: bytes, location: str) -> Iterator[dict]:
    for r in markdown.parsed(content.decode("utf-8-sig", "replace"), _title(location)):
        if r["record"] == "section":
            yield {"order_index": r["order_index"], "toc_path": r["toc_path"], "level": r["level"], "kind": "text", "section_text": r["text"]}


def _page(content: bytes, location: str) -> Iterator[dict]:
    for s in web.parse_page(content.decode("utf-8-sig", "replace"), location)[1]:
        yield {**s, "kind": "text"}


def _plain(content: bytes, location: str) -> Iterator[dict]:
    text = content.decode("utf-8", "replace").replace("﻿", "").replace("\0", "").replace("\r\n", "\n").replace("\r", "\n").strip()
    yield {"order_index": 0, "toc_path": [_title(location)], "level": 1, "kind": "text", "section_text": text or _title(location)}


def defaults() -> dict[str, Parser]:
    """Parsers by type of source (`files.SUFFIXES`); a caller adds parsers of its own, for PDF or images, say."""
    own: dict[str, Parser] = {"markdown": _markdown, "web": _page, "plain_text": _plain}
    return own | {kind: (lambda content, location, parse=parse: parse(content)) for kind, parse in office.PARSERS.items()}


_SCHEMA = "path string, source_type string, order_index int, toc_path array<string>, level int, kind string, section_text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("source_type", pa.string()), *((f.name, f.type) for f in office._ARROW if f.name != "path")])


def parse_files(contents: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """Sections of files (path, content: as `binaryFile` or the archive source gives them), each by the parser of its suffix.

    A file without a parser, or one that its parser refuses, gives one row with the error. Null content is
    empty; `binaryFile` itself leaves empty files out.
    """
    ship(contents.sparkSession)
    known = defaults() | (parsers or {})

    def rows(path: str, kind: str | None, content: bytes) -> Iterator[dict]:
        if kind not in known:
            return iter([{"error": "no parser for this type"}])
        try:
            return iter(list(known[kind](content, path)))
        except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
            return iter([{"error": f"{type(e).__name__}: {e}"}])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, kind = b.column("path")[k].as_py(), b.column("source_type")[k].as_py()
                out = [{"path": path, "source_type": kind, **{n: r.get(n) for n in _ARROW.names[2:]}} for r in rows(path or "", kind, b.column("content")[k].as_py() or b"")]
                if out:
                    yield pa.RecordBatch.from_pylist(out, _ARROW)

    return contents.select("path", files.source_type(F.col("path")).alias("source_type"), "content").mapInArrow(run, _SCHEMA)


# --- table functions ---------------------------------------------------------------------------

_NAMES = [x.split()[0] for x in markdown._COLUMNS.split(", ")]
_SECTION = "order_index int, toc_path array<string>, level int, kind string, section_text string"


class MarkdownBlocks:
    def eval(self, text: str, title: str):
        for r in markdown.parsed(text or "", title or ""):
            yield tuple(r.get(n) for n in _NAMES)


class FileSections:
    def eval(self, content: bytes, location: str, kind: str):
        for s in defaults()[kind](bytes(content or b""), location or ""):
            yield s["order_index"], s["toc_path"], s["level"], s["kind"], s["section_text"]


def register(spark: SparkSession) -> None:
    """Makes table functions known to a session's SQL, to be used with LATERAL: markdown_blocks(text, title), with the columns of `markdown.parse`, and file_sections(content, location, source_type)."""
    ship(spark)
    spark.udtf.register("markdown_blocks", udtf(MarkdownBlocks, returnType=markdown._COLUMNS))
    spark.udtf.register("file_sections", udtf(FileSections, returnType=_SECTION))
