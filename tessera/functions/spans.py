"""Token spans and windows in numpy, for Arrow batches: offsets are code points, half-open."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.runtime import ship

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of runs of ASCII letters and digits and of single CJK characters."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    word = _ALNUM[np.minimum(points, 255)] & (points < 128)
    cjk = ((points >= 0x3400) & (points <= 0x4DBF)) | ((points >= 0x4E00) & (points <= 0x9FFF))
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero((word & ~np.r_[False, word[:-1]]) | cjk)
    end = np.flatnonzero((word & ~np.r_[word[1:], False]) | cjk) + 1
    return start, end


def window_bounds(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of windows over n tokens; the last is the first that reaches the end."""
    step, out = max(size - overlap, 1), []
    for a in range(0, n, step):
        out.append((a, min(a + size, n)))
        if a + size >= n:
            break
    return out


WINDOW = "window_index int, token_start int, token_end int, char_start int, char_end int, window_text string"


def windows(df: DataFrame, key: str, text: str, size: int, overlap: int, least: int = 1) -> DataFrame:
    """A row per window of each text: key, WINDOW columns. Windows of fewer than `least` tokens are
    left out and don't use up an index. A text without tokens, or null, has none."""
    ship(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, which, rows = b.slice(at, 256), [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    start, end = token_spans(t or "")
                    n = 0
                    for x, y in window_bounds(len(start), size, overlap):
                        if y - x >= least:
                            lo, hi = int(start[x]), int(end[y - 1])
                            rows.append((n, x, y, lo, hi, t[lo:hi]))
                            which.append(k)
                            n += 1
                if rows:
                    cols = [pa.array(c, pa.string() if j == 5 else pa.int32()) for j, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *cols], names=[key, *(x.split()[0] for x in WINDOW.split(", "))])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {WINDOW}")


def clip(text: str, budget: int, ellipsis: bool = False) -> str:
    """The first `budget` tokens of a text, one at least; " ..." after it where something is left out and `ellipsis` is set."""
    text = text.strip()
    start, end = token_spans(text)
    if len(start) <= max(budget, 1):
        return text
    return text[: int(end[max(budget, 1) - 1])].strip() + (" ..." if ellipsis else "")


def tail(text: str, budget: int) -> str:
    """The last `budget` tokens of a text and what follows them; nothing for a budget of 0 or a text without tokens."""
    text = text.strip()
    start, _ = token_spans(text)
    return text[int(start[max(len(start) - budget, 0)]) :].strip() if budget > 0 and len(start) else ""


def sample(text: str, most: int = 5000, head: int = 1500, middle: int = 1500, tail: int = 1500) -> str:
    """The whole text up to `most` tokens, else its head, middle and tail."""
    start, end = token_spans(text)
    n = len(start)
    if n <= most:
        return text
    first = max(head, (n - middle) // 2)
    parts = [text[: int(end[head - 1])].strip(), text[int(start[first]) : int(end[min(first + middle, n) - 1])].strip(), text[int(start[max(n - tail, 0)]) :].strip()]
    return "\n...\n".join(p for p in parts if p).strip()
