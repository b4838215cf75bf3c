"""Profiles of tables: column types, sample rows, header rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.runtime import ship

PROFILE_ROWS = 50
SAMPLE_ROWS = 3
# Fixed values of header detection.
TEXT_CELL, CONCISE, LEAST_SCORE, LEAST_COLUMNS = 80, 30, 0.55, 2
_NUMBER = re.compile(r"-?[\d,.]+%?")
_SCIENTIFIC = re.compile(r"-?\d+\.?\d*[eE][+-]?\d+")
_DATE = re.compile(r"\d{1,4}[-/年]\d{1,2}[-/月]\d{1,2}[日号]?")
_CLOCK = re.compile(r"\d+:\d+")


def as_number(c: Column) -> Column:
    """The number in a cell, thousands separators and a final % left out, or null."""
    plain = F.trim(F.regexp_replace(F.trim(F.replace(c, F.lit(","), F.lit(""))), "%$", ""))
    return plain.try_cast("double")


def melted(df: DataFrame, order: list[str], rows: int = PROFILE_ROWS) -> DataFrame:
    """position, column_name, cell of the first `rows` rows by `order`; these rows are a feature of the profile."""
    from pyspark.sql.window import Window

    first = df.orderBy(*order).limit(rows)
    first = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    cells = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("column_name"), F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias("cell")) for k, c in enumerate(df.columns)))
    return first.select("position", F.explode(cells).alias("x")).select("position", "x.*")


def column_types(df: DataFrame, order: list[str], rows: int = PROFILE_ROWS) -> DataFrame:
    """place, column_name, type, low and high of each column: empty, number, enum or text."""
    cells = melted(df, order, rows).where("cell <> ''").withColumn("number", as_number(F.col("cell")))
    g = cells.groupBy("place", "column_name").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("numeric"), F.min("number").alias("low"), F.max("number").alias("high"), F.count_distinct("cell").alias("distinct"))
    number = F.col("numeric") >= F.greatest(F.lit(1), F.floor(F.col("n") * 0.7))
    enum = (F.col("distinct") <= 10) & (F.col("distinct") <= F.greatest(F.lit(3), F.floor(F.col("n") / 2)))
    kind = F.when(number, "number").when(enum, "enum").otherwise("text")
    found = g.select("place", "column_name", kind.alias("type"), F.when(number, F.col("low")).alias("low"), F.when(number, F.col("high")).alias("high"))
    every = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(df.columns)], "place int, column_name string")
    return every.join(found.drop("column_name"), "place", "left").withColumn("type", F.coalesce("type", F.lit("empty")))


def markdown(df: DataFrame) -> Column:
    """A row as a markdown table row."""
    cells = [F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in df.columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def parse_markdown(text: Column) -> Column:
    """Rows of cells of a markdown table: lines in |...|, separator rows left out."""
    lines = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")) & F.endswith(x, F.lit("|")) & ~x.rlike(r"^[|\-: ]+$"))
    return F.transform(lines, lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


# --- header rows -------------------------------------------------------------------------------


def is_label(cell: str) -> bool:
    """Text that may name a column: not a number, date or time, and not long."""
    cell = cell.strip()
    return bool(cell) and len(cell) <= TEXT_CELL and not (_NUMBER.fullmatch(cell.replace(" ", "")) or _SCIENTIFIC.fullmatch(cell) or _DATE.fullmatch(cell) or _CLOCK.match(cell))


def row_scores(rows: list[list[str]]) -> list[float]:
    """How much each row looks like a header; rows that can't be one have -1."""
    width, out = max(map(len, rows), default=0), []
    rows = [[str(c or "").strip() for c in r] + [""] * (width - len(r)) for r in rows]
    for k, row in enumerate(rows):
        cells = [c for c in row if c]
        labels = [c for c in cells if is_label(c)]
        if len(cells) < LEAST_COLUMNS or len(labels) < len(cells) or len(cells) / width < 0.4:
            out.append(-1.0)
            continue
        below = rows[k + 1 :]
        fresh = sum(all(r[j] != c for r in below) for j, c in enumerate(row) if c)
        mean = sum(map(len, cells)) / len(cells)
        brief = 1.0 if mean <= CONCISE else max(0.0, 1 - (mean - CONCISE) / 60)
        change = 0.0
        if below:
            nxt = [c for c in below[0] if c]
            alike = len(set(cells) & set(nxt)) / len(set(cells) | set(nxt)) if nxt else 0.0
            change = 0.5 * (len(labels) >= max(len(cells) / 2, 2) and any(not is_label(c) for c in nxt)) + 0.3 * (len(nxt) >= max(0.3 * len(cells), 1)) + 0.2 * (alike < 0.3)
        out.append(0.40 + fresh / len(cells) * min(max(len(below), 1) / 5, 1) * 0.15 + brief * 0.10 + min(1.2 * len(cells) / width, 1) * 0.10 + min(change, 1.0) * 0.25)
    return out


def header_rows(rows: list[list[str]]) -> list[int]:
    """Rows of the header: the longest run of rows with a good score, one other row in between allowed."""
    good = [k for k, s in enumerate(row_scores(rows)) if s >= LEAST_SCORE]
    runs: list[list[int]] = []
    for k in good:
        if runs and k - runs[-1][-1] <= 2:
            runs[-1].append(k)
        else:
            runs.append([k])
    scores = row_scores(rows)
    return max(runs, key=lambda r: (len(r), sum(scores[k] for k in r) / len(r)), default=[])


def header_columns(rows: list[list[str]]) -> list[str]:
    """Names of the columns: cells of the header's rows joined by _, and numbered where they repeat."""
    picked, seen, out = header_rows(rows), {}, []
    for j in range(max(map(len, rows), default=0)):
        parts = list(dict.fromkeys(str(rows[k][j]).strip() for k in picked if j < len(rows[k]) and str(rows[k][j]).strip()))
        name = "_".join(parts) or f"column_{j + 1}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def detect_headers(sheets: DataFrame) -> DataFrame:
    """sheet_id, header_rows, columns of sheets (sheet_id, rows: array of arrays of strings)."""
    ship(sheets.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column("rows").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("sheet_id"), pa.array([header_rows(r or []) for r in rows], pa.list_(pa.int32())), pa.array([header_columns(r or []) for r in rows], pa.list_(pa.string()))], names=["sheet_id", "header_rows", "columns"])

    return sheets.select("sheet_id", "rows").mapInArrow(run, f"sheet_id {sheets.schema['sheet_id'].dataType.simpleString()}, header_rows array<int>, columns array<string>")
