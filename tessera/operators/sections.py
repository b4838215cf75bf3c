"""Sections and what belongs to them: refining into windows, records, texts by byte range, anchors, neighbours, grounding."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import spans
from tessera.functions import text as T
from tessera.operators import context
from tessera.runtime import ship

# Fixed value: what an asset anchor looks like.
ANCHOR = r"\[ASSET_ANCHOR:([^\]]+)\]"
WINDOW_TOKENS, WINDOW_OVERLAP = 220, 30
MOST_WINDOWS, MOST_SECTIONS, MOST_ASSETS = 6, 2, 2
MOST_BYTES = 4096
# Items of a query that are read, and tokens that they may give together.
MOST_TARGETS, OUTPUT_TOKENS = 3, 8000


# --- refining ----------------------------------------------------------------------------------


def _around_anchors(anchors: list[tuple[int, int, str]], lo: int, hi: int, placed: set[str]) -> tuple[int, int] | None:
    """lo..hi moved so that it cuts no anchor; an anchor belongs to the first window that it begins in, and later ones leave it out."""
    for a, b, ref in anchors:
        if b <= lo or a >= hi:
            continue
        if ref not in placed and a >= lo:
            hi = max(hi, b)
            placed.add(ref)
        elif ref not in placed:
            lo = b if lo < b else lo
        elif lo < b < hi:
            lo = b
        elif lo < a < hi:
            hi = a
        else:
            return None
    return (lo, hi) if lo < hi else None


def refined(text: str, size: int, overlap: int, most: int | None = None) -> list[tuple[int, int, int, int]]:
    """(token start, token end, first character, end) of the windows of a text of over `most` tokens; no windows if it stays whole."""
    start, end = spans.token_spans(text)
    if len(start) <= max(most or size, 1) or len(start) <= size:
        return []
    anchors = [(m.start(), m.end(), m[1]) for m in re.finditer(ANCHOR, text)]
    out, placed = [], set()
    for x, y in spans.window_bounds(len(start), size, overlap):
        if found := _around_anchors(anchors, int(start[x]), int(end[y - 1]), placed):
            out.append((x, y, *found))
    return out if len(out) > 1 else []


_PART = "window_index int, window_count int, token_start int, token_end int, char_start int, char_end int, section_text string"


def refine(sections: DataFrame, key: str, text: str, size: int, overlap: int, most: int | None = None) -> DataFrame:
    """A row per section after refining: key and the columns of _PART, character offsets being those in the section's text.

    A section of over `most` tokens becomes windows of `size` tokens; asset anchors are never cut and
    stand in one window only. A section that stays whole is window 0 of 1, from its first to its last
    character; a null text is empty.
    """
    ship(sections.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part, which, rows = b.slice(at, 256), [], []
                for k, t in enumerate(part.column(1).to_pylist()):
                    t = t or ""
                    found = refined(t, size, overlap, most)
                    n = len(spans.token_spans(t)[0]) if not found else 0
                    rows += [(i, len(found), x, y, lo, hi, t[lo:hi]) for i, (x, y, lo, hi) in enumerate(found)] or [(0, 1, 0, n, 0, len(t), t)]
                    which += [k] * max(1, len(found))
                if rows:
                    cols = [pa.array(c, pa.string() if j == 6 else pa.int32()) for j, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), *cols], names=[key, *(x.split()[0] for x in _PART.split(", "))])

    return sections.select(key, text).mapInArrow(run, f"{key} {sections.schema[key].dataType.simpleString()}, {_PART}")


def section_records(parts: DataFrame, key: str, anchor: Column, begin: Column) -> DataFrame:
    """Records of refined sections (as `refine` gives them): absolute ranges, anchors, flags, hash and metadata.

    `anchor` is the section's own anchor, `begin` its first character in the document. Windows are
    named anchor-part-1 and on.
    """
    window = F.col("window_count") > 1
    refs = T.asset_references("section_text")
    return parts.select(
        key, "window_index", "window_count", (begin + F.col("char_start")).alias("char_range_start"), (begin + F.col("char_end")).alias("char_range_end"),
        F.when(window, F.concat(anchor, F.lit("-part-"), (F.col("window_index") + 1).cast("string"))).otherwise(anchor).alias("anchor"),
        F.when(window, "token_window").alias("refine_strategy"), F.array_distinct(refs).alias("asset_refs"),
        F.exists(refs, lambda r: F.startswith(F.lower(r), F.lit("table"))).alias("has_table"), F.exists(refs, lambda r: F.startswith(F.lower(r), F.lit("figure")) | F.startswith(F.lower(r), F.lit("image"))).alias("has_figure"),
        F.sha2(F.col("section_text").cast("binary"), 256).alias("content_hash"), "section_text",
    )


# --- texts and anchors -------------------------------------------------------------------------


def section_texts(sections: DataFrame, objects: DataFrame) -> DataFrame:
    """sections (section_id, object_key, byte_start, byte_end, ...) with section_text, read from objects (object_key, content).

    An empty or missing range gives an empty text, a missing object the marker of unavailable content.
    """
    read = F.substring("content", F.col("byte_start") + 1, F.col("byte_end") - F.col("byte_start"))
    empty = F.col("object_key").isNull() | F.col("byte_start").isNull() | F.col("byte_end").isNull() | (F.col("byte_end") <= F.col("byte_start"))
    marker = F.concat(F.lit("[CONTENT_UNAVAILABLE:section_id="), F.col("section_id").cast("string"), F.lit("]"))
    text = F.when(empty, "").when(F.col("content").isNull() | (F.length(read) == 0), marker).otherwise(F.decode(read, "utf-8"))
    return sections.join(objects.select("object_key", F.col("content").cast("binary").alias("content")), "object_key", "left").withColumn("section_text", text).drop("content")


def asset_text(preview: Column, caption: Column, content: Column) -> Column:
    """Preview, else caption, else the first 4,096 bytes; null if all are blank."""
    first = F.decode(F.substring(content.cast("binary"), F.lit(1), F.lit(MOST_BYTES)), "utf-8")
    return F.coalesce(*(F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in (preview, caption, first)))


def compute_block(asset_id: Column, sheet: Column, rows: Column, columns: Column, fields: Column, tokens: Column) -> Column:
    """What stands for a table in a prompt: where it is from, its shape and its columns (an array of structs of name and type)."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    lines = F.transform(F.slice(fields, 1, 40), lambda f: F.concat(F.lit("  "), F.rpad(f["name"], F.greatest(F.lit(40), F.length(f["name"])), " "), F.lit(" -> "), f["type"]))
    head = F.array(
        F.concat(F.lit("[TABLE_COMPUTE_ONLY:asset_id="), asset_id.cast("string"), F.lit("]")), F.concat(F.lit("Source: "), F.coalesce(sheet, F.lit("unknown"))),
        F.concat(F.lit("Shape: "), known(rows), F.lit(" rows x "), known(columns), F.lit(" columns")), F.concat(F.lit("Estimated full size: ~"), known(tokens), F.lit(" tokens (too large to load in context)")),
    )
    return F.array_join(F.concat(head, F.when(F.size(lines) > 0, F.concat(F.array(F.lit(""), F.lit("Schema:")), lines)).otherwise(F.array().cast("array<string>"))), "\n")


def with_assets(sections: DataFrame, assets: DataFrame) -> DataFrame:
    """sections (section_id, section_text, ...) whose anchors are replaced by the texts of their assets (section_id, asset_id, anchor, asset_text).

    An asset with an `anchor_text`, where there is such a column, is replaced by that: so tables stand as their compute block, not as their rows.
    """
    if "anchor_text" in assets.columns:
        assets = assets.withColumn("asset_text", F.coalesce("anchor_text", "asset_text"))
    own = assets.where(F.length("anchor") > 0).groupBy("section_id").agg(F.sort_array(F.collect_list(F.struct("asset_id", "anchor", F.coalesce("asset_text", F.lit("")).alias("t")))).alias("__assets"))
    filled = F.aggregate(F.coalesce("__assets", F.array().cast(own.schema["__assets"].dataType)), F.col("section_text"), lambda t, a: F.replace(t, a["anchor"], a["t"]))
    return sections.join(own, "section_id", "left").withColumn("section_text", filled).drop("__assets")


def neighbours(sections: DataFrame, radius: int = 1, most: int = MOST_SECTIONS) -> DataFrame:
    """section_id, neighbour_id, place: up to `most` sections within `radius` places of the same group.

    A group is what shares doc_id, source_id, toc_path and parent_section_id, of those that sections
    have as columns; a section whose parent is null has no neighbours. A section with a window_index
    meets those whose windows are near, nearest first, then by window, order_index and id; others meet those
    near by order_index and id, in that order. Band joins by offsets: no pairs of a group are formed.
    """
    for name in ("parent_section_id", "window_index"):
        if name not in sections.columns:
            sections = sections.withColumn(name, F.lit(0 if name == "parent_section_id" else None).cast("long"))
    keys = ["doc_id", *(c for c in ("source_id", "toc_path", "parent_section_id") if c in sections.columns)]
    own = sections.where(F.col("parent_section_id").isNotNull())
    group = F.xxhash64(*keys)  # nulls are values here, so groups are compared by what they hold
    at = own.select(*keys, group.alias("__group"), "order_index", "window_index", "section_id")
    row = Window.partitionBy("__group", *keys).orderBy("order_index", "section_id")
    steps = [d for d in range(-radius, radius + 1) if d]
    beside = F.array(*(F.struct(F.lag("section_id", -d).over(row).alias("neighbour_id"), F.lit(i).alias("n")) for i, d in enumerate(steps)))
    plain = at.withColumn("beside", beside).where("window_index IS NULL").select("section_id", F.inline("beside")).where("neighbour_id IS NOT NULL")
    plain = plain.select("section_id", "neighbour_id", F.struct(F.col("n").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c")).alias("by"))
    windows = at.where("window_index IS NOT NULL")
    other = windows.select(F.col("__group"), *(F.col(k).alias(f"__{k}") for k in keys), F.col("window_index").alias("__at"), F.col("order_index").alias("__order"), F.col("section_id").alias("neighbour_id"))
    asked = windows.withColumn("step", F.explode(F.array(*(F.lit(d) for d in range(-radius, radius + 1))))).withColumn("__at", F.col("window_index") + F.col("step"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    near = asked.join(other, ["__group", "__at"]).where(same & (F.col("section_id") != F.col("neighbour_id")))
    near = near.select("section_id", "neighbour_id", F.struct(F.abs("step").cast("long").alias("a"), F.col("__at").cast("long").alias("b"), F.col("__order").cast("long").alias("c")).alias("by"))
    place = F.row_number().over(Window.partitionBy("section_id").orderBy("by", "neighbour_id"))
    return plain.unionByName(near).withColumn("place", place).where(F.col("place") <= most).select("section_id", "neighbour_id", "place")


# --- grounding ---------------------------------------------------------------------------------


def _placed(items: DataFrame, target: str) -> DataFrame:
    """items with place (by score and target where they have none), evidence_id and text of their own (null where they have none)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(target).cast("string"))
    out = items if "place" in items.columns else items.withColumn("place", F.row_number().over(order))
    for name in ("evidence_id", "text"):
        out = out if name in out.columns else out.withColumn(name, F.lit(None).cast("string"))
    return out.withColumn("terms", T.search_terms("query"))


def _section_windows(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Windows of the sections that are wanted (query_id, place, terms, score, section_id, source), each section being cut once."""
    w = spans.windows(texts.join(wanted.select("section_id").distinct(), "section_id", "left_semi"), "section_id", "section_text", WINDOW_TOKENS, WINDOW_OVERLAP)
    bare = texts.where((F.size(T.terms("section_text")) == 0) & (F.trim("section_text") != "")).select("section_id", F.lit(0).alias("window_index"), F.col("section_text").alias("window_text"))
    parts = w.select("section_id", "window_index", "window_text").unionByName(bare)
    text = F.rtrim(F.trim("window_text"), F.lit("."))
    name = F.concat(F.lit("grounded:section:"), F.col("section_id").cast("string"), F.lit(":"), (F.col("window_index") + 1).cast("string"))
    return wanted.join(parts, "section_id").select("query_id", "place", "terms", "score", name.alias("evidence_id"), F.lit("section").alias("record_type"), text.alias("text"), "source").where("text <> ''")


def _locally_ranked(found: DataFrame, most: int) -> DataFrame:
    """The `most` best pieces of each item."""
    score = context.local_score(F.col("score"), T.keyword_overlap(F.col("terms"), "text"), F.lit(None).cast("int"), F.lit(1))
    item = ["query_id", "place"]
    best = found.withColumn("local_score", score).withColumn("__n", F.row_number().over(Window.partitionBy(*item, "evidence_id").orderBy(F.desc("local_score"), "source"))).where("__n = 1")
    order = Window.partitionBy(*item).orderBy(F.desc("local_score"), "evidence_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "place", "evidence_id", "record_type", "text", "source", "local_score", "rank")


def _missing(items: DataFrame, known: DataFrame, target: str) -> DataFrame:
    """What stands for items whose target isn't known: their own text."""
    left = items.join(known.select(target).distinct(), target, "left_anti")
    name = F.coalesce("evidence_id", F.concat(F.lit(f"{target.removesuffix('_id')}:"), F.col(target).cast("string")))
    return left.select("query_id", "place", name.alias("evidence_id"), F.lit("item").alias("record_type"), F.coalesce("text", F.lit("")).alias("text"), F.lit("item").alias("source"), F.round("score", 6).alias("local_score"), F.lit(1).alias("rank"))


def within_budget(pieces: DataFrame, tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Pieces (query_id, place, rank, evidence_id, text) in the order of place and rank until `tokens` are used up, with n_tokens of what is left of each.

    A piece that an earlier item of the query has too counts once. The piece that crosses the budget
    is clipped. Pieces without tokens go; of a query that has no others the items themselves stay.
    """
    first = Window.partitionBy("query_id", "evidence_id").orderBy("place", "rank")
    once = pieces.withColumn("__n", F.row_number().over(first)).where("__n = 1").withColumn("n_tokens", T.text_unit_count("text").cast("long"))
    any_ = F.max("n_tokens").over(Window.partitionBy("query_id")) > 0
    some = once.withColumn("__any", any_).where((F.col("n_tokens") > 0) | ((F.col("record_type") == "item") & ~F.col("__any"))).drop("__any")
    before = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("query_id").orderBy("place", "rank", "evidence_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = some.withColumn("__left", tokens - before).where(F.col("__left") > 0)
    short = F.col("n_tokens") > F.col("__left")
    clipped = F.when(short, _clipped("text", "__left")).otherwise(F.col("text"))
    return kept.withColumn("text", clipped).withColumn("n_tokens", F.least("n_tokens", "__left")).drop("__left", "__n")


def _clipped(text: str, tokens: str) -> Column:
    @F.pandas_udf("string")
    def clip(texts: pd.Series, room: pd.Series) -> pd.Series:
        return pd.Series([spans.clip(t, int(n), True) for t, n in zip(texts, room)], dtype=object)

    return clip(F.col(text), F.col(tokens))


def _grounded_sections(asked: DataFrame, sections: DataFrame, texts: DataFrame, assets: DataFrame, most: int) -> DataFrame:
    cols = ["query_id", "place", "terms", "score", "section_id"]
    near = asked.join(neighbours(sections).drop("place"), "section_id").select("query_id", "place", "terms", "score", F.col("neighbour_id").alias("section_id"), F.lit("neighbour").alias("source"))
    windows = _section_windows(asked.select(*cols, F.lit("hit").alias("source")).unionByName(near), texts)
    first = assets.withColumn("n", F.row_number().over(Window.partitionBy("section_id").orderBy("asset_id"))).where((F.col("n") <= MOST_ASSETS) & (F.length(F.trim("asset_text")) > 0))
    name = F.concat(F.lit("grounded:asset:"), F.col("asset_id").cast("string"))
    own = asked.select(*cols).join(first, "section_id").select("query_id", "place", "terms", "score", name.alias("evidence_id"), F.lit("asset").alias("record_type"), F.rtrim(F.trim("asset_text"), F.lit(".")).alias("text"), F.lit("asset").alias("source"))
    return _locally_ranked(windows.unionByName(own), most)


_MOST = MOST_WINDOWS + MOST_SECTIONS + MOST_ASSETS


def ground_sections(items: DataFrame, sections: DataFrame, texts: DataFrame, assets: DataFrame, most: int = _MOST, targets: int = MOST_TARGETS, tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Evidence for hits on sections: items (query_id, query, section_id, score; place, evidence_id and text where they have them).

    Sections as `neighbours` takes them, texts (section_id, section_text) with anchors filled in,
    assets (section_id, asset_id, asset_text). Of each query the first `targets` items by place are
    read. Each gives up to `most` pieces: windows of its section, of its neighbours, and its first two
    assets, by score and terms in common; an item whose section isn't there stands by its own text.
    Pieces follow by item and rank until `tokens` are used up. Returns query_id, place, evidence_id,
    record_type, text, source, local_score, rank, n_tokens.
    """
    ship(items.sparkSession)
    asked = _placed(items, "section_id").where(F.col("place") <= targets)
    return within_budget(_grounded_sections(asked, sections, texts, assets, most).unionByName(_missing(asked, sections, "section_id")), tokens)


def best_sections(items: DataFrame, sections: DataFrame, texts: DataFrame, most: int = MOST_SECTIONS) -> DataFrame:
    """Hits on documents (query_id, query, doc_id, score) become hits on their `most` sections that share most terms with the query; n is a section's place among them."""
    asked = items.withColumn("terms", T.search_terms("query")).drop("section_id")
    own = sections.join(texts.select("section_id", "section_text"), "section_id").select("section_id", "doc_id", "order_index", T.search_terms("section_text").alias("own"))
    overlap = F.size(F.array_intersect("terms", "own"))
    order = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("overlap"), "order_index", "section_id")
    best = asked.join(own, "doc_id").withColumn("overlap", overlap).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return best.select(*items.columns, "section_id", "n")


def ground_documents(items: DataFrame, sections: DataFrame, texts: DataFrame, assets: DataFrame, targets: int = MOST_TARGETS, tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Evidence for hits on documents (query_id, query, doc_id, score): their best sections, each grounded as such; a document without sections stands by the hit's own text."""
    ship(items.sparkSession)
    asked = _placed(items, "doc_id").where(F.col("place") <= targets)
    best = best_sections(asked.drop("terms"), sections, texts).withColumn("terms", T.search_terms("query"))
    each = _grounded_sections(best.withColumn("place", F.col("place") * MOST_SECTIONS + F.col("n")), sections, texts, assets, _MOST)
    whole = each.withColumn("rank", F.col("rank") + (F.col("place") - 1) % MOST_SECTIONS * _MOST).withColumn("place", F.floor((F.col("place") - 1) / MOST_SECTIONS).cast("int"))
    return within_budget(whole.unionByName(_missing(asked, sections, "doc_id")), tokens)


def ground_assets(items: DataFrame, assets: DataFrame, targets: int = MOST_TARGETS, tokens: int = OUTPUT_TOKENS) -> DataFrame:
    """Evidence for hits on assets (query_id, query, asset_id, score): the text of each; a hit whose asset is missing or blank stands by its own text."""
    ship(items.sparkSession)
    asked = _placed(items, "asset_id").where(F.col("place") <= targets)
    some = assets.where(F.length(F.trim("asset_text")) > 0).dropDuplicates(["asset_id"])
    own = asked.drop("text", "evidence_id").join(some, "asset_id")
    name = F.concat(F.lit("grounded:asset:"), F.col("asset_id").cast("string"))
    found = _locally_ranked(own.select("query_id", "place", "terms", "score", name.alias("evidence_id"), F.lit("asset").alias("record_type"), F.trim("asset_text").alias("text"), F.lit("asset").alias("source")), 1)
    return within_budget(found.unionByName(_missing(asked, some, "asset_id")), tokens)
