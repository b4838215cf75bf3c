"""Markdown as blocks: headings, paragraphs, list items, code, tables, figures, captions and footnotes become elements, sections and assets."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import spans
from tessera.functions import text as T
from tessera.runtime import ship

# Kinds of elements that are assets, what each is to its section, and the tokens of a preview.
RELATIONS = {"table": "table_of", "figure": "figure_of", "image_summary": "figure_of", "caption": "caption_of", "speaker_note": None, "ocr_region": None}
PREVIEW_TOKENS = 1000
#: Rows, and characters of their texts, at which a parser's rows are sent on.
SENT_ROWS, SENT_CHARS = 4096, 1 << 20
# Fixed values of table profiles.
POLICY, TYPED_ROWS, SHOWN_ROWS, SHOWN_VALUES = "compute_only", 50, 3, 6

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^`]*)$")
_QUOTE = re.compile(r"(?:[ \t]*>)+ ?")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:")
_ITEM = re.compile(r"[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_INDENT = re.compile(r"(?: {4}| {0,3}\t)")
_IMAGE = re.compile(r'!\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+"([^"\n]*)")?\)')
_CAPTION = re.compile(r"(?i)(figure|fig\.|table|图|表)\s*\d+(?:\.\d+)*\s*(?:[:：.。|-](?:\s|$)|$)")
_INLINE = re.compile(r'``?([^`\n]+)``?|\[([^\[\]\n]*)\]\([^()\s]*(?:[ \t]+"[^"\n]*")?\)|\*\*(?=\S)([^*\n]+)\*\*|(?<!\w)__(?=\S)([^_\n]+)__(?!\w)|\*(?=\S)([^*\n]+)\*|(?<!\w)_(?=\S)([^_\n]+)_(?!\w)|\\([!-/:-@\[-`{-~])')


class Block(NamedTuple):
    kind: str
    text: str
    level: int = 0
    caption: str = ""


def _squeeze(text: str) -> str:
    return " ".join(text.split())  # white space is the same set as a pattern's \s


def _lines(text: str) -> str:
    """White space within lines squeezed, blank lines left out."""
    return "\n".join(x for x in map(_squeeze, text.split("\n")) if x)


def _slug(text: str) -> str:
    return re.sub(r"[^a-z0-9一-鿿]+", "-", _squeeze(text).lower()).strip("-") or "section"


def _plain(text: str) -> str:
    """Text without the marks of links, emphasis, code and escapes."""

    def inner(m: re.Match) -> str:
        found = next(g for g in m.groups() if g is not None)
        return found if m[1] is not None or m[7] is not None else _plain(found)

    return _INLINE.sub(inner, text)


def cells(line: str) -> list[str]:
    """Cells of a table row; an escaped bar divides nothing."""
    line = line.strip()
    line = line[1:] if line.startswith("|") else line
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


def _row(row: list[str]) -> str:
    return "| " + " | ".join(row) + " |"


def _flow(held: list[str], kind: str) -> Iterator[Block]:
    """A paragraph or item as blocks: its text, and its images as figures between."""
    text, at = "\n".join(held), 0
    for m in _IMAGE.finditer(text):
        if before := _lines(_plain(text[at : m.start()])):
            yield Block(kind, before)
        yield Block("figure", _squeeze(m[1]), 0, _squeeze(_plain(m[2] or "")))
        at = m.end()
    if rest := _lines(_plain(text[at:])):
        yield Block(kind, rest)


def blocks(lines: list[str]) -> Iterator[Block]:
    """The blocks of a text's lines, in one pass over them. Unclosed fences reach to the end; an unclosed comment is text."""
    last_close = max((k for k, x in enumerate(lines) if "-->" in x), default=-1)
    held: list[str] = []
    kind, listed, k = "paragraph", False, 0

    def flushed() -> list[Block]:
        nonlocal kind
        out, kind = list(_flow(held, kind)), "paragraph"
        held.clear()
        return out

    while k < len(lines):
        line = lines[k]
        first, k = k, k + 1
        if m := _FENCE.match(line):
            yield from flushed()
            shut = re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while k < len(lines) and not shut.match(lines[k]):
                k += 1
            yield Block("code", _lines("\n".join(lines[first + 1 : k])))
            k += 1
        elif not line.strip():
            yield from flushed()
        elif line.lstrip().startswith(">"):
            yield from flushed()
            while k < len(lines) and lines[k].lstrip().startswith(">"):
                k += 1
            yield from blocks([_QUOTE.sub("", x, count=1) for x in lines[first:k]])
        elif line.lstrip().startswith("<!--") and first <= last_close:
            yield from flushed()
            while "-->" not in lines[k - 1]:
                k += 1
        elif not held and not listed and _INDENT.match(line):
            while k < len(lines) and (_INDENT.match(lines[k]) or not lines[k].strip()):
                k += 1
            yield Block("code", _lines("\n".join(lines[first:k])))
        elif m := _HEADING.match(line):
            yield from flushed()
            text = (m[2] or "").strip()
            bare = text.rstrip("#")
            text = bare if not bare or bare[-1] in " \t" else text
            listed = False
            if text := _squeeze(_plain(text)):
                yield Block("heading", text, len(m[1]))
        elif held and kind == "paragraph" and (m := _SETEXT.match(line)):
            text = _squeeze(_plain(" ".join(held)))
            held.clear()
            listed = False
            yield Block("heading", text, 1 if m[1][0] == "=" else 2)
        elif _RULE.match(line):
            yield from flushed()
        elif "|" in line and k < len(lines) and _DELIMITER.match(lines[k]) and len(cells(line)) == len(cells(lines[k])):
            yield from flushed()
            width = len(cells(line))
            k += 1
            while k < len(lines) and lines[k].strip() and "|" in lines[k] and not _FENCE.match(lines[k]) and not _HEADING.match(lines[k]):
                k += 1
            rows = [(cells(x) + [""] * width)[:width] for x in (line, *lines[first + 2 : k])]
            yield Block("table", "\n".join([_row(rows[0]), "|" + "---|" * width, *map(_row, rows[1:])]))
        elif _FOOTNOTE.match(line):
            yield from flushed()
            while k < len(lines) and lines[k].strip() and not _FOOTNOTE.match(lines[k]):
                k += 1
            yield Block("footnote", _lines("\n".join(lines[first:k])))
        elif m := _ITEM.match(line):
            yield from flushed()
            kind, listed = "list_item", True
            held.append(m[1])
        else:
            if not held and not line[0].isspace():
                listed = False
            held.append(line.strip())
    yield from flushed()


def captioned(found: list[Block]) -> list[Block]:
    """A paragraph such as "Table 2: ..." next to a table or figure is its caption: of the one before it, else of the one after."""
    out = list(found)
    for k, b in enumerate(out):
        m = _CAPTION.match(b.text) if b.kind == "paragraph" else None
        if m is None:
            continue
        of = "table" if m[1].lower() in ("table", "表") else "figure"
        near = next((j for j in (k - 1, k + 1) if 0 <= j < len(out) and out[j].kind == of and not out[j].caption), None)
        if near is not None:
            out[near] = out[near]._replace(caption=_squeeze(b.text))
            out[k] = b._replace(kind="caption")
    return out


def parsed(text: str, title: str) -> Iterator[dict]:
    """Rows of a text: its elements and its sections, as `parse` describes them."""
    found = captioned([b for b in blocks(text.replace("\r\n", "\n").replace("\r", "\n").split("\n")) if b.text or b.kind == "figure"])
    name = next((b.text for b in found if b.kind == "heading" and b.level == 1), "") or _squeeze(title) or "document"
    path, stack, level, anchor = [name], [], 1, _slug(name)
    parts: list[str] = []
    tables = 0
    counts: dict[str, int] = {}
    chars = size = order = place = 0

    def element(kind: str, text: str, **more) -> dict:
        nonlocal place
        counts[kind] = counts.get(kind, 0) + 1
        place += 1
        return {"record": "element", "order_index": place - 1, "element_id": f"{anchor}-{kind}-{counts[kind]}", "kind": kind, "text": text, "toc_path": list(path), **more}

    def section() -> Iterator[dict]:
        nonlocal chars, size, order, tables
        if not (text := "\n\n".join(parts)):
            return
        parts.clear()
        gap = 2 if order else 0
        a, b = chars + gap, size + gap
        chars, size, order, held, tables = a + len(text), b + len(text.encode()), order + 1, tables, 0
        yield {"record": "section", "order_index": order - 1, "text": text, "toc_path": list(path), "level": level, "anchor": anchor, "char_start": a, "char_end": chars, "byte_start": b, "byte_end": size, "tables": held}

    for b in found:
        if b.kind == "heading" and b.level == 1:
            path, anchor = [b.text], _slug(b.text)
        elif b.kind == "heading":
            yield from section()
            level = b.level - 1
            stack = [*stack[: level - 1], b.text]
            path = [name, *stack]
            anchor = _slug("-".join(path))
            yield element("section_header", b.text, level=level)
        elif b.kind == "table":
            row = element("table", b.text, caption=b.caption or None)
            tables += 1
            parts.append(f"[ASSET_ANCHOR:{quote(row['element_id'], safe='-_.:')}]")
            yield row
        elif b.kind == "figure":
            caption = b.caption or b.text
            if caption:
                parts.append(caption)
            yield element("figure", caption or "figure", caption=caption or None)
        elif b.kind == "caption":
            yield element("caption", b.text)
        elif b.kind != "footnote":
            parts.append(b.text)
            yield element("text", b.text, level=level, label=b.kind)
    yield from section()
    if not order:
        parts.append(name)
        path, level, anchor = [name], 1, _slug(name)
        yield from section()


_COLUMNS = "record string, order_index int, element_id string, kind string, label string, text string, toc_path array<string>, level int, anchor string, caption string, char_start int, char_end int, byte_start int, byte_end int, tables int"
_FIELDS = [pa.field(n, {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (x.split() for x in _COLUMNS.split(", "))]


def parse(documents: DataFrame, key: str, text: str, title: str, record: str | None = None) -> DataFrame:
    """Elements and sections of markdown texts, a row each, told apart by `record`; `key` names a document, one row each.

    With `record`, 'element' or 'section', only those rows leave the parser.

    The first heading of level 1 is the title, and `title` where there is none; deeper ones nest below it, the
    second level being 1. Elements: section_header, text (label paragraph, list_item or code), table, figure,
    caption; footnotes, comments and rules are none. Tables stand in their section as an anchor, figures as
    their caption (title of the image, a caption paragraph, its alternative text). Sections carry
    their range in the visible text, which is all sections joined by a blank line. A null or empty text gives
    one section that holds the title. A text is held by one task, and read once.
    """
    ship(documents.sparkSession)
    held = documents.schema[key].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of, size = [], [], 0

            def sent(b=b) -> pa.RecordBatch:
                columns = [pa.array([r.get(f.name) for r in rows], f.type) for f in _FIELDS]
                out = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *columns], names=[key, *(f.name for f in _FIELDS)])
                rows.clear()
                of.clear()
                return out

            # Rows of short texts go together, those of a long one in parts.
            for k in range(b.num_rows):
                for row in parsed(b.column(1)[k].as_py() or "", b.column(2)[k].as_py() or ""):
                    if record is None or row["record"] == record:
                        rows.append(row)
                        of.append(k)
                        size += len(row["text"])
                    if len(rows) >= SENT_ROWS or size >= SENT_CHARS:
                        yield sent()
                        size = 0
            if rows:
                yield sent()

    chosen = documents.select(key, F.col(text).cast("string").alias("text"), F.col(title).cast("string").alias("title"))
    return chosen.mapInArrow(run, f"`{key}` {held.simpleString()}, {_COLUMNS}")


def elements(rows: DataFrame, key: str) -> DataFrame:
    return rows.where("record = 'element'").select(key, "order_index", "element_id", "kind", "label", "text", "toc_path", "level", "caption")


def sections(rows: DataFrame, key: str) -> DataFrame:
    """Sections with the references that stand in them (asset_refs), a text's own words in that form too, and the number of tables that the parser put there."""
    own = rows.where("record = 'section'").select(key, "order_index", "toc_path", "level", "anchor", "char_start", "char_end", "byte_start", "byte_end", "tables", F.col("text").alias("section_text"))
    refs = F.array_distinct(T.asset_references("section_text"))
    return own.withColumn("asset_refs", refs)


# --- assets ------------------------------------------------------------------------------------


def _number(cell: str) -> float | None:
    bare = cell.replace(",", "").strip().removesuffix("%").strip()
    try:
        return float(bare)
    except ValueError:
        return None


def _type(values: list[str]) -> str:
    full = [v for v in values if v]
    numbers = [n for n in map(_number, full) if n is not None]
    if not full:
        return "empty"
    if len(numbers) >= max(1, int(len(full) * 0.7)):
        return f"number(min={min(numbers):g}, max={max(numbers):g})"
    distinct = list(dict.fromkeys(full))
    if len(distinct) <= 10 and len(distinct) <= max(3, len(full) // 2):
        return f"enum({', '.join(distinct[:SHOWN_VALUES])})"
    return "text"


def profile(text: str) -> dict:
    """Rows, columns, types and a summary of a markdown table, whose first row is its header. Types are those of the first 50 rows."""
    lines = [x.strip() for x in text.strip().split("\n")]
    rows = [cells(x) for x in lines if len(x) > 1 and x.startswith("|") and x.endswith("|")]
    rows = [r for r in rows if not all(c and set(c) <= set("-: ") for c in r)]
    head, data = (rows[0], rows[1:]) if rows else ([], [])
    width = max(map(len, rows), default=0)
    names = [head[j] if j < len(head) and head[j] else f"column_{j + 1}" for j in range(width)]
    padded = lambda r: (r + [""] * width)[:width]
    types = [_type([padded(r)[j] for r in data[:TYPED_ROWS]]) for j in range(width)]
    tokens = len(spans.token_spans(text.strip())[0])
    shown = [_row(names), "|" + "|".join(["---"] * width) + "|", *(_row(padded(r)) for r in data[:SHOWN_ROWS])] if data else ["(no data rows)"]
    summary = [
        f"Table policy: {POLICY}",
        f"Table shape: rows={len(data)}, columns={width}, estimated_tokens={tokens}",
        f"Table columns: {' | '.join(names)}",
        f"Field types: {'; '.join(f'{n}={t}' for n, t in zip(names, types))}",
        "Sample rows:",
        *shown,
    ]
    return {"row_count": len(data), "column_count": width, "estimated_tokens": tokens, "table_policy": POLICY, "columns": names, "types": types, "preview": "\n".join(summary).strip()}


_ASSET = "element_id string, asset_type string, relation_type string, toc_path array<string>, caption string, content_hash string, row_count int, column_count int, estimated_tokens int, table_policy string, columns array<string>, types array<string>, preview string"


def asset_records(found: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Asset records of elements (as `elements` gives them; other kinds of assets may be added): relation, hash, preview, a table's profile, and the section.

    The section is the one that holds the asset's anchor, else the first with the asset's path; null if there
    is none. Previews are cut off after 1,000 tokens; those of tables are their summary.
    """
    ship(found.sparkSession)
    kept = found.where(F.col("kind").isin(*RELATIONS)).select(key, "element_id", "kind", F.coalesce("text", F.lit("")).alias("text"), "toc_path", "caption")
    names = [x.split()[0] for x in _ASSET.split(", ")]
    kinds = [{"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[x.split()[1]] for x in _ASSET.split(", ")]

    def record(row: dict) -> dict:
        text, kind = row["text"], row["kind"]
        more = profile(text) if kind == "table" else {"preview": spans.clip(text, PREVIEW_TOKENS)}
        return {"element_id": row["element_id"], "asset_type": kind, "relation_type": RELATIONS[kind], "toc_path": row["toc_path"], "caption": row["caption"], "content_hash": sha256(text.encode()).hexdigest(), **more}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [record(r) for r in b.select(names_in).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds))], names=[key, *names])

    names_in = kept.columns[1:]
    records = kept.mapInArrow(run, f"`{key}` {found.schema[key].dataType.simpleString()}, {_ASSET}")
    anchored = sections.select(key, F.explode("asset_refs").alias("element_id"), F.col("order_index").alias("by_anchor")).groupBy(key, "element_id").agg(F.min("by_anchor").alias("by_anchor"))
    pathed = sections.groupBy(key, "toc_path").agg(F.min("order_index").alias("by_path"))
    joined = records.join(anchored, [key, "element_id"], "left").join(pathed, [key, "toc_path"], "left")
    return joined.select(key, *names, F.coalesce("by_anchor", "by_path").alias("section_index"))
