"""Files and records: routing by suffix, plain text and markdown parsing, JSON lines, benchmark inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T

# Which parser a suffix goes to.
SUFFIXES = {
    "pdf": "pdf", "md": "markdown", "markdown": "markdown", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "xls": "xlsx",
    "png": "image", "jpg": "image", "jpeg": "image", "bmp": "image", "tif": "image", "tiff": "image", "html": "web", "htm": "web", "txt": "plain_text",
}


def source_type(location: Column) -> Column:
    """Type by the suffix of a path or address, query and fragment aside; null if it has none that is known."""
    path = F.regexp_replace(location, r"[?#].*$", "")
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in SUFFIXES.items() for x in kv))
    return F.try_element_at(known, suffix)


def plain_text(text: Column, title: Column) -> Column:
    """One section: no byte-order mark or NUL, line feeds for CRLF and CR; the title if nothing is left."""
    body = F.regexp_replace(F.regexp_replace(T.text_of(text), "[﻿\u0000]", ""), "\r\n?", "\n")
    return F.coalesce(F.nullif(T.strip(body), F.lit("")), title)


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, order_index, toc_path, level, section_text: text under each heading, with the path of headings above it.

    The path is built per line by an ordered fold over the lines of one document.
    """
    lines = F.split(F.regexp_replace(T.text_of(text), "\r\n?", "\n"), "\n")
    start = F.struct(F.array().cast("array<struct<toc_path:array<string>,level:int,body:array<string>>>").alias("done"), F.array().cast("array<string>").alias("path"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("body"))

    def step(acc, line):
        marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s+\S", 1))
        heading = F.trim(F.regexp_replace(line, r"^#{1,6}\s+", ""))
        closed = F.when(F.exists(acc["body"], lambda x: F.trim(x) != ""), F.concat(acc["done"], F.array(F.struct(acc["path"].alias("toc_path"), acc["level"].alias("level"), acc["body"].alias("body"))))).otherwise(acc["done"])
        deeper = F.struct(closed.alias("done"), F.concat(F.slice(acc["path"], F.lit(1), F.least(marks - 1, F.size(acc["path"]))), F.array(heading)).alias("path"), marks.alias("level"), F.array().cast("array<string>").alias("body"))
        more = F.struct(acc["done"].alias("done"), acc["path"].alias("path"), acc["level"].alias("level"), F.concat(acc["body"], F.array(line)).alias("body"))
        return F.when(marks > 0, deeper).otherwise(more)

    folded = docs.select(key, F.aggregate(F.concat(lines, F.array(F.lit("# end"))), start, step)["done"].alias("done"))
    return folded.select(key, F.posexplode("done").alias("order_index", "s")).select(key, "order_index", "s.toc_path", "s.level", T.strip(F.array_join("s.body", "\n")).alias("section_text"))


# Which suffixes a folder of private documents is searched for; images may be .webp, there is no .xls.
DISCOVERED = {
    "pdf": "pdf", "md": "markdown", "markdown": "markdown", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "txt": "plain_text",
}


def declared_type(location: Column, declared: Column) -> Column:
    """The type by suffix; an error where another is declared."""
    found = source_type(location)
    wrong = declared.isNotNull() & found.isNotNull() & (declared != found)
    message = F.concat(F.lit("declared as "), declared, F.lit(" but "), location, F.lit(" is "), found)
    return F.when(wrong, F.raise_error(message).cast("string")).otherwise(F.coalesce(found, declared))


def requests(paths: DataFrame, owner: str) -> DataFrame:
    """Ingest requests for the paths (path) that have a known suffix and no leading dot, in order: location, source_type, owner, title, file_name."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in DISCOVERED.items() for x in kv))
    rows = paths.select(F.col("path").alias("location"), F.try_element_at(known, suffix).alias("source_type"), F.lit(owner).alias("owner"), F.regexp_replace(name, r"\.[^.]+$", "").alias("title"), name.alias("file_name"))
    return rows.where(F.col("source_type").isNotNull() & ~F.startswith("file_name", F.lit("."))).orderBy("location")


def discover(spark: SparkSession, folder: str, owner: str, recursive: bool = True) -> DataFrame:
    """The requests for the files of a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    return requests(files.select("path"), owner)


def with_defaults(documents: DataFrame) -> DataFrame:
    """Prepared documents (doc_id, title, text, metadata) as requests: the id is the default title, the title the default text, the id goes into the metadata unless it is there."""
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.col("doc_id").cast("string"))
    key = F.lit("benchmark_doc_id")
    meta = F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    own = F.when(F.map_contains_key(meta, key), meta).otherwise(F.map_concat(meta, F.create_map(key, F.col("doc_id").cast("string"))))
    return documents.select("doc_id", title.alias("title"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), title).alias("text"), own.alias("metadata"))


def export_sections(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """What is exported of sections (with section_text) and the titles of their documents; to be written as JSON lines."""
    cols = ["section_id", "parent_section_id", "order_index", "toc_path", "char_range_start", "char_range_end", "window_index", "window_count"]
    joined = sections.join(documents.select("doc_id", "source_id", "title"), "doc_id")
    return joined.select("doc_id", "source_id", "title", *cols, F.col("section_text").alias("text")).orderBy("doc_id", "order_index", "section_id")


def _qrels(rows: DataFrame, query: list[str], doc: list[str], relevance: list[str]) -> DataFrame:
    have = lambda names: [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in rows.columns]
    score = [F.nullif(c.try_cast("int"), F.lit(0)) for c in have(relevance)]
    ids = [F.coalesce(*have(names)) if have(names) else F.lit(None).cast("string") for names in (query, doc)]
    needed = [F.coalesce(c, F.raise_error(F.lit(f"a judgment has no {n}")).cast("string")).alias(n) for c, n in zip(ids, ("query_id", "doc_id"))]
    return rows.select(*needed, F.coalesce(*score, F.lit(0)).alias("relevance"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of a tab-separated file with a header (query-id, corpus-id, score, or the plain names)."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return _qrels(rows, ["query-id", "query_id"], ["corpus-id", "doc_id"], ["score", "relevance"])


def read_qrels_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """query_id, doc_id, relevance of JSON lines (qid, pid, score, or the plain names)."""
    rows = spark.read.schema("qid string, query_id string, pid string, doc_id string, score string, relevance string").json(path)
    return _qrels(rows, ["qid", "query_id"], ["pid", "doc_id"], ["score", "relevance"])


def append_rows(history: DataFrame | None, rows: DataFrame) -> DataFrame:
    """A history with rows added; columns that either side lacks are null there, the history's come first."""
    return rows if history is None else history.unionByName(rows, allowMissingColumns=True)


def prepared(queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries that have a positive judgment, and the positive judgments."""
    positive = qrels.where("relevance > 0")
    return queries.join(positive.select("query_id").distinct(), "query_id", "left_semi"), positive


def mini_subset(docs: DataFrame, queries: DataFrame, qrels: DataFrame, n_queries: int, n_docs: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """A seeded sample of queries with a positive judgment, all their positive documents, and others up to `n_docs`.

    The subset is the feature. Positive documents all stay, be they more than `n_docs`.
    """
    eligible, positive = prepared(queries, qrels)
    q = eligible.orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(n_queries)
    wanted = positive.join(q, "query_id", "left_semi").select("doc_id").distinct()
    gold = docs.join(wanted, "doc_id", "left_semi")
    fill = docs.join(wanted, "doc_id", "left_anti").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max(n_docs - gold.count(), 0))
    return q, gold.unionByName(fill).orderBy("doc_id")
