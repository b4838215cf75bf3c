"""Word, PowerPoint and Excel files, read with the standard library: they are zip archives of XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.tables import header_columns
from tessera.runtime import ship


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _attribute(node: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def _section(order: int, path: list[str], level: int, text: str, kind: str = "text") -> dict:
    return {"order_index": order, "toc_path": path, "level": level, "kind": kind, "section_text": text}


def _table(node: ElementTree.Element) -> str:
    rows = [[_text(c).strip() for c in r if _local(c.tag) == "tc"] for r in node.iter() if _local(r.tag) == "tr"]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def parse_docx(content: bytes) -> list[dict]:
    """Text under each heading, with the path of headings; tables as sections of their own."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    out: list[dict] = []
    path, level, held = [], 0, []

    def flush() -> None:
        if text := "\n".join(x for x in held if x.strip()).strip():
            out.append(_section(len(out), list(path), level, text))
        held.clear()

    for node in next((x for x in body.iter() if _local(x.tag) == "body"), []):
        if _local(node.tag) == "tbl":
            flush()
            out.append(_section(len(out), list(path), level, _table(node), "table"))
        elif _local(node.tag) == "p":
            style = next((_attribute(x, "val") or "" for x in node.iter() if _local(x.tag) == "pStyle"), "")
            m = re.fullmatch(r"(?i)heading\s*([1-9])", style)
            if m and _text(node).strip():
                flush()
                level = int(m[1])
                path = [*path[: level - 1], _text(node).strip()]
            else:
                held.append(_text(node))
    flush()
    return out


def parse_pptx(content: bytes) -> list[dict]:
    """A section for each slide that has text: its shapes, its tables, then the speaker's notes."""
    number = lambda n: int(re.findall(r"\d+", n)[-1])
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
            root, parts = ElementTree.fromstring(z.read(name)), []
            for node in root.iter():
                if _local(node.tag) == "sp":
                    parts += [t for p in node.iter() if _local(p.tag) == "p" and (t := _text(p).strip())]
                elif _local(node.tag) == "tbl":
                    parts.append(_table(node))
            notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            if notes in z.namelist() and (t := _text(ElementTree.fromstring(z.read(notes))).strip()):
                parts.append(f"Notes: {t}")
            if parts:
                out.append(_section(len(out), [f"Slide {number(name)}"], 1, "\n".join(parts)))
    return out


def _column(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows of cells) of the sheets of a workbook that have cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [_attribute(x, "name") or "" for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"] if "xl/workbook.xml" in names else []
        out = []
        files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        for k, name in enumerate(files):
            rows = []
            for row in (x for x in ElementTree.fromstring(z.read(name)).iter() if _local(x.tag) == "row"):
                cells: dict[int, str] = {}
                for j, c in enumerate(x for x in row if _local(x.tag) == "c"):
                    value = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    kind = c.get("t")
                    text = shared[int(value)] if kind == "s" and value else _text(c) if kind == "inlineStr" else value
                    cells[_column(c.get("r")) if c.get("r") else j] = text
                rows.append([cells.get(j, "") for j in range(max(cells, default=-1) + 1)])
            if any(any(c.strip() for c in r) for r in rows):
                out.append((titles[k] if k < len(titles) else f"Sheet{k + 1}", rows))
    return out


def parse_xlsx(content: bytes) -> list[dict]:
    """A table section for each sheet that has cells: its columns and the number of its rows."""
    return [_section(k, [name], 1, f"columns: {', '.join(header_columns(rows))}\nrows: {len(rows)}", "table") for k, (name, rows) in enumerate(sheets(content))]


PARSERS: dict[str, Callable[[bytes], list[dict]]] = {"docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx}
_SCHEMA = "path string, order_index int, toc_path array<string>, level int, kind string, section_text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("order_index", pa.int32()), ("toc_path", pa.list_(pa.string())), ("level", pa.int32()), ("kind", pa.string()), ("section_text", pa.string()), ("error", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Sections of the Office files below a folder. A file that can't be read gives one row with its error."""
    ship(spark)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column("path")[k].as_py()
                try:
                    rows = [{"path": name, "error": None, **s} for s in PARSERS[name.rpartition(".")[2].lower()](b.column("content")[k].as_py())]
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError) as e:
                    rows = [{"path": name, "error": f"{type(e).__name__}: {e}"}]
                if rows:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in _ARROW.names} for r in rows], _ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*PARSERS))
    return files.select("path", "content").mapInArrow(run, _SCHEMA)
