"""Operator 3, quality rules: compression bands.

A text whose zstandard ratio (bytes over compressed bytes) is outside the band for its length is
repetitive (above) or incompressible (below). The ratio is taken over the whole text and over fixed
chunks, as a repetitive part of a long text hardly moves the whole's ratio.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import blocks, gram_hash, mix, owner, prefix_hash, span_hash, sum_by, table, word_spans
from tessera.runtime import ship

SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


@dataclass(frozen=True)
class Bands:
    """Limits by length in bytes: (up to, least ratio, most ratio), the last for any length."""

    #: Prose of these lengths has ratios about a tenth below the upper limits; short texts vary more.
    limits: tuple[tuple[float, float, float], ...] = field(
        default=((128, 0.0, 2.0), (256, 0.9, 2.2), (512, 1.1, 2.2), (1024, 1.2, 2.25), (2048, 1.35, 2.35), (4096, 1.5, 2.45), (8192, 1.6, 2.6), (16384, 1.65, 2.7), (float("inf"), 1.7, 2.9))
    )
    chunk: int = 4096
    #: A last chunk shorter than this is judged with the whole text only.
    least_chunk: int = 1024
    #: Most share of the chunks that may be outside their band.
    bad_chunks: float = 0.3
    level: int = 3

    def inside(self, size: int, ratio: float) -> bool:
        low, high = next((lo, hi) for up, lo, hi in self.limits if size <= up)
        return low <= ratio <= high


DEFAULT = Bands()


def verdict(text: bytes, bands: Bands, z: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks, chunks outside their band, kept). An empty text has ratio 0 and is kept."""
    if not text:
        return 0.0, 0, 0, True
    ratio = len(text) / len(z.compress(text))
    chunks = bad = 0
    if len(text) > bands.chunk:
        for at in range(0, len(text), bands.chunk):
            piece = text[at : at + bands.chunk]
            if len(piece) >= bands.least_chunk:
                chunks += 1
                bad += not bands.inside(len(piece), len(piece) / len(z.compress(piece)))
    return ratio, chunks, bad, bands.inside(len(text), ratio) and bad <= bands.bad_chunks * chunks


def word_statistics(data: np.ndarray, offs: np.ndarray, window: int = 8) -> dict[str, np.ndarray]:
    """Per text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(offs) - 1
    start, end, firsts = word_spans(data, offs)
    who, c = owner(firsts), prefix_hash(data, fold=False)
    out = {"n_words": np.diff(firsts)}

    leads = np.zeros(len(data) + 1, np.int64)  # code points so far
    np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
    out["word_chars"] = sum_by(leads[end] - leads[start], who, n)
    out["n_symbols"] = np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[data]), offs))

    feeds = np.flatnonzero(data == 10)  # a line begins at its text's start or after a line feed
    line_start, line_end = np.sort(np.r_[offs[:-1], feeds + 1]), np.sort(np.r_[feeds, offs[1:]])
    line_of = np.searchsorted(offs, line_start, "right") - 1
    worded = np.searchsorted(start, line_start) < np.searchsorted(start, line_end)
    line_start, line_end, line_of = line_start[worded], line_end[worded], line_of[worded]
    key = span_hash(c, line_start, line_end) ^ mix(line_of.astype(np.uint64))
    _, kept = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(line_of, minlength=n) - np.bincount(line_of[kept], minlength=n)

    grams = gram_hash(span_hash(c, start, end), window)
    whole = who[: len(grams)] == who[window - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    key = grams[at] ^ mix(who[at].astype(np.uint64))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(start) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    out["n_repeat_words"] = sum_by(np.cumsum(edge[:-1]) > 0, who, n)
    return out


_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, kept boolean"


def compression_bands(docs: DataFrame, bands: Bands = DEFAULT, min_words: int = 20, max_repeat: float = 0.3) -> DataFrame:
    """A row per document (doc_id, text): word statistics, the base rule and the bands' verdict.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, ratio,
    n_chunks, n_bad_chunks, kept. base_failed: fewer than `min_words` words, or over `max_repeat` of
    them in repeated 8-word windows. A null text counts as empty: no words, so base_failed. A null
    doc_id stays null; repeated rows each get their row; other columns are ignored.
    """
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text")):
                s = word_statistics(data, offs)
                failed = (s["n_words"] < min_words) | (s["n_repeat_words"] > max_repeat * s["n_words"])
                raw = data.tobytes()
                ratio, chunks, bad, inside = zip(*(verdict(raw[x:y], bands, z) for x, y in zip(offs[:-1], offs[1:])))
                cols = [b.column("doc_id").slice(lo, hi - lo), *(pa.array(v, pa.int64()) for v in s.values()), pa.array(failed), pa.array(ratio, pa.float64()), pa.array(chunks, pa.int64()), pa.array(bad, pa.int64()), pa.array(np.array(inside) & ~failed)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(x.split()[0] for x in _SCHEMA.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word statistics, base rule and bands of every whole text of `documents`; see compression_bands."""
    return compression_bands(table(spark, sf_dir, "documents"))
