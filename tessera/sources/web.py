"""Web pages: title, sections with their heading path, and character spans of the visible text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_UNSEEN = {"script", "style", "template"}


def _squeeze(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


class _Page(HTMLParser):
    """Collects title, headings and paragraphs, each with the container that it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.title: str | None = None
        self.blocks: list[tuple[str, list[str], bool, bool]] = []  # tag, texts, in the first article, in body
        self.live: list[int] = []
        self.articles = 0
        self.in_first_article = 0
        self.texts: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        if tag == "p" and "p" in self.open:
            self._close("p")
        self.open.append(tag)
        if tag == "article":
            self.articles += 1
            if self.articles == 1:
                self.in_first_article = len(self.open)
        if tag == "title" and self.title is None:
            self.title = ""
        if tag == "p" or re.fullmatch("h[1-6]", tag):
            self.live.append(len(self.blocks))
            self.blocks.append((tag, [], bool(self.in_first_article), "body" in self.open))

    def _close(self, tag: str) -> None:
        while self.open:
            last = self.open.pop()
            if last == "article" and self.in_first_article > len(self.open):
                self.in_first_article = 0
            if (last == "p" or re.fullmatch("h[1-6]", last)) and self.live:
                self.live.pop()
            if last == tag:
                return

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close(tag)

    def handle_data(self, data):
        if _UNSEEN & set(self.open) or not data.strip():
            return
        if self.open and self.open[-1] == "title" and self.title is not None:
            self.title += data
        self.texts.append(data.strip())
        for k in self.live:
            self.blocks[k][1].append(data.strip())


def parse_page(html: str, location: str) -> tuple[str, list[dict]]:
    """(title, sections). A section has order_index, toc_path, level, section_text, char_start, char_end.

    The container is the first article, else body, else the page. Sections are joined by a space;
    a page without headings and paragraphs is one section of all its text.
    """
    page = _Page()
    page.feed(html)
    page.close()
    blocks = [b for b in page.blocks if b[2]] if page.articles else [b for b in page.blocks if b[3]] or page.blocks
    headings = [_squeeze(" ".join(t)) for tag, t, *_ in page.blocks if tag != "p"]
    title = _squeeze(page.title or "") or (headings[0] if headings else "") or location.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0] or "document"
    sections: list[dict] = []
    path, level, held, at = [title], 1, [], 0

    def flush() -> None:
        nonlocal held, at
        if text := _squeeze(" ".join(held)):
            at += bool(sections)
            sections.append({"order_index": len(sections), "toc_path": list(path), "level": level, "section_text": text, "char_start": at, "char_end": at + len(text)})
            at += len(text)
        held = []

    for tag, texts, *_ in blocks:
        text = _squeeze(" ".join(texts))
        if tag == "p":
            held.append(text)
        else:
            flush()
            level = int(tag[1])
            path = [*path[: level - 1], text]
    flush()
    if not sections:
        text = _squeeze(" ".join(page.texts)) or title
        sections.append({"order_index": 0, "toc_path": [title], "level": 1, "section_text": text, "char_start": 0, "char_end": len(text)})
    return title, sections


_SECTION = "title string, order_index int, toc_path array<string>, level int, section_text string, char_start int, char_end int"
_ARROW = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.int32(), pa.int32()]


def sections(pages: DataFrame) -> DataFrame:
    """A row per section of pages (page_id, url, html). A null html is an empty page."""
    ship(pages.sparkSession)
    names = [x.split()[0] for x in _SECTION.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, which, rows = b.slice(at, 64), [], []
                for k, (url, html) in enumerate(zip(part.column("url").to_pylist(), part.column("html").to_pylist())):
                    title, found = parse_page(html or "", url or "")
                    rows += [{"title": title, **s} for s in found]
                    which += [k] * len(found)
                yield pa.RecordBatch.from_arrays([part.column("page_id").take(pa.array(which)), *(pa.array([r[n] for r in rows], t) for n, t in zip(names, _ARROW))], names=["page_id", *names])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id long, {_SECTION}")


def title_text(html: Column | str) -> Column:
    """The text of the first title element as it stands: white space squeezed, the four references of XML decoded where they
    end in a semicolon, nothing else taken for one. Empty without a title, null for a null page. No page is parsed."""
    found = F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)
    out = F.regexp_replace(F.regexp_replace(found, r"[\t\n\f\r ]+", " "), r"^\p{Zs}+|\p{Zs}+$", "")
    for name, text in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(text))
    return out
