"""A stored index of terms: postings in blocks with bounds of their impacts, changed per document, exact BM25 by pruning.

Documents are tokenised once, when they are put in. Each task makes segments of at most SEGMENT
documents, ordered by id, and writes a row per term and block of at most BLOCK postings: numbers of documents,
term counts, lengths, the greatest count and the least length. A document that is replaced or removed
is marked dead in its segment, with its terms counted as gone, so frequencies stay exact without the
segments being rewritten; `compact` does that. A search reads the rows of its terms only and sends them by segment to
tasks that skip what can't reach the k best so far: a segment or a block whose bound is too low.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import text as T
from tessera.operators import search
from tessera.runtime import ship
from tessera.sources.store import Store

SEGMENT, BLOCK = 8192, 128
#: Tokens after which a segment is closed, however few documents it has.
SEGMENT_TOKENS = 1 << 22
#: Tokens that are counted at a time, and rows of a segment that are sent at a time.
TOKENS, SENT = 1 << 18, 4096
#: Terms up to which a search names them to the scan; more of them come by a join.
NAMED_TERMS = 1000
_ROW = "segment string, term string, block int, n int, max_tf int, min_length int, docs array<int>, tf array<int>, length array<int>"


def _counted(ids: pa.Array, tokens: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Some documents without their tokens: ids, lengths, distinct terms, and document, term and count of each pair."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), np.int32)
    coded = tokens.flatten().dictionary_encode()
    doc, width = np.repeat(np.arange(len(ids), dtype=np.int64), lengths), max(1, len(coded.dictionary))
    key, tf = np.unique(doc * width + np.asarray(coded.indices), return_counts=True) if len(doc) else (np.zeros(0, np.int64),) * 2
    return ids, lengths, coded.dictionary, *(v.astype(np.int32) for v in (key // width, key % width, tf))


def _segment(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of one segment of counted documents: first its documents, with '' as a term and all their tokens as greatest count, then its terms in order."""
    name = uuid.uuid4().hex
    ids = pa.concat_arrays([p[0] for p in parts])
    order = np.array(sorted(range(len(ids)), key=list(map(str, ids.to_pylist())).__getitem__), np.int64)
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    ids, lengths = ids.take(pa.array(order)), np.concatenate([p[1] for p in parts])[order]
    coded = pa.concat_arrays([p[2] for p in parts]).dictionary_encode()
    by_term = np.asarray(pc.sort_indices(coded.dictionary), np.int64)
    place = np.empty(len(by_term), np.int64)
    place[by_term] = np.arange(len(by_term))
    place = place[np.asarray(coded.indices)]
    first_doc, first_term = (np.cumsum([0, *(len(p[k]) for p in parts)]) for k in (0, 2))
    key = np.concatenate([place[p[4] + t] * len(ids) + number[p[3] + d] for p, d, t in zip(parts, first_doc, first_term)])
    tf = np.concatenate([p[5] for p in parts])
    parts.clear()
    sort = np.argsort(key)  # pairs don't repeat
    key, tf = key[sort], tf[sort]
    del sort
    term, doc = (key // max(1, len(ids))).astype(np.int32), (key % max(1, len(ids))).astype(np.int32)
    del key
    first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    at = np.arange(len(term), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(np.r_[first, len(term)]))
    starts = np.flatnonzero(at % BLOCK == 0)
    one = lambda v: pa.array([v], pa.int32())
    numbers, whole = pa.array([np.arange(len(ids), dtype=np.int32)], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32()))
    head = [pa.array([name]), pa.array([""]), one(0), one(len(ids)), one(int(lengths.sum(dtype=np.int64))), one(0), numbers, pa.nulls(1, pa.list_(pa.int32())), whole, pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)]
    names = [*(x.split()[0] for x in _ROW.split(", ")), "ids"]
    yield pa.RecordBatch.from_arrays(head, names=names)
    for lo in range(0, len(starts), SENT):
        own, end = starts[lo : lo + SENT], starts[lo + SENT] if lo + SENT < len(starts) else len(term)
        d, n = doc[own[0] : end], tf[own[0] : end]
        length, cuts = lengths[d], own - own[0]
        edges = np.r_[cuts, len(d)].astype(np.int32)
        lists = lambda values: pa.ListArray.from_arrays(pa.array(edges), pa.array(values))  # noqa: B023, E731
        many = [pa.array([name] * len(own), pa.string()), coded.dictionary.take(pa.array(by_term[term[own]])), pa.array(at[own] // BLOCK), pa.array(np.diff(edges))]
        many += [pa.array(f.reduceat(v, cuts)) for f, v in ((np.maximum, n), (np.minimum, length))]
        yield pa.RecordBatch.from_arrays([*many, lists(d), lists(n), lists(length), pa.nulls(len(own), pa.list_(ids.type))], names=names)


def _segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of documents (id, tokens). What is held of a segment are its pairs of document and term, four bytes a number, not its tokens."""
    held, n, size = [], 0, 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(b.column(1).slice(at, SEGMENT - n)), 0), np.int64))
            # As many as fit; a document is whole, so the last may pass the number of tokens.
            part = b.slice(at, min(len(ends), 1 + int(np.searchsorted(ends, min(TOKENS, SEGMENT_TOKENS - size)))))
            held.append(_counted(part.column(0), part.column(1)))
            at, n, size = at + part.num_rows, n + part.num_rows, size + int(held[-1][1].sum(dtype=np.int64))
            if n >= SEGMENT or size >= SEGMENT_TOKENS:
                yield from _segment(held)
                held, n, size = [], 0, 0
    if n:
        yield from _segment(held)


class Postings:
    """An index of documents (doc_id, text) in a folder. Changes are commits of a manifest, as the store's."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = Store(spark, self.path, ["segment"], "segment")

    # --- changes -------------------------------------------------------------------------------

    def _read(self, kind: str, version: int | None = None) -> DataFrame | None:
        _, manifest = self.log._manifest(version)
        if not manifest["schema"]:
            return None
        own = [f"{self.path}/{f}" for f in manifest["files"].get(kind, ())]
        id_type = StructType.fromJson(manifest["schema"])["doc_id"].dataType.simpleString()
        schema = f"{_ROW}, ids array<{id_type}>" if kind == "segments" else {"dead": "segment string, docs array<int>, length long", "gone": "term string, n long"}[kind]
        return self.spark.read.schema(schema).parquet(*own) if own else self.spark.createDataFrame([], schema)

    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("parquet.block.size", 16 << 20).option("parquet.bloom.filter.enabled#term", "true").option("parquet.bloom.filter.expected.ndv#term", "30000").parquet(f"{self.path}/{folder}")
        return folder

    def _live(self) -> DataFrame:
        """segment, no, doc_id, length of the documents that aren't dead."""
        heads = self._read("segments").where("term = ''").select("segment", "ids", F.explode(F.arrays_zip("docs", "length")).alias("d"))
        each = heads.select("segment", F.col("d.docs").alias("no"), F.get("ids", F.col("d.docs")).alias("doc_id"), F.col("d.length").cast("long").alias("length"))
        return each.join(self._read("dead").select("segment", F.explode("docs").alias("no")), ["segment", "no"], "left_anti")

    def put(self, docs: DataFrame, tokens: Column | None = None) -> None:
        """Puts documents in place of those with the same ids; the ids of docs don't repeat. A null text has no terms."""
        tokens = T.terms("text") if tokens is None else tokens
        self._change(docs.select("doc_id", tokens.alias("tokens")), docs.select("doc_id"))

    def remove(self, ids: DataFrame) -> None:
        """Takes out the documents whose doc_id is in ids."""
        self._change(None, ids.select("doc_id"))

    def _change(self, added: DataFrame | None, leaving: DataFrame) -> None:
        ship(self.spark)
        base, manifest = self.log._manifest()
        files = {k: list(v) for k, v in manifest["files"].items()}
        schema = StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        if schema is not None:
            live = self._live()
            out = live.join(leaving.distinct(), live["doc_id"].eqNullSafe(leaving["doc_id"]), "left_semi")
            dead = self._write(out.groupBy("segment").agg(F.sort_array(F.collect_list("no")).alias("docs"), F.sum("length").alias("length")))  # a segment's documents at most
            now = self.spark.read.schema("segment string, docs array<int>, length long").parquet(f"{self.path}/{dead}")
            if not now.isEmpty():
                # A flag for each number of a segment: rows of terms look theirs up, whatever the number of those that leave.
                flags = F.transform(F.sequence(F.lit(0), F.array_max("docs")), lambda i: F.array_contains("docs", i))
                hit = self._read("segments").where("term <> ''").select("segment", "term", "docs").join(now.select("segment", flags.alias("left")), "segment")
                terms = hit.select("term", F.size(F.filter("docs", lambda d: F.get("left", d))).alias("n")).where("n > 0").groupBy("term").agg(F.sum("n").cast("long").alias("n"))
                files["dead"] = [*files.get("dead", ()), dead]
                files["gone"] = [*files.get("gone", ()), self._write(terms)]
        if added is not None:
            schema = StructType([added.schema["doc_id"]])
            rows = added.mapInArrow(_segments, f"{_ROW}, ids array<{schema['doc_id'].dataType.simpleString()}>")
            files["segments"] = [*files.get("segments", ()), self._write(rows)]
        if schema is not None and files != manifest["files"]:
            self.log._commit(base, schema, files)

    def compact(self) -> None:
        """Rewrites the segments without their dead documents, as one generation."""
        base, manifest = self.log._manifest()
        if not manifest["schema"]:
            return
        dead = self._read("dead").groupBy("segment").agg(F.flatten(F.collect_list("docs")).alias("left"))
        rows, keep = self._read("segments").join(dead, "segment", "left"), F.array_compact(F.transform("docs", lambda d, i: F.when(~F.array_contains("left", d), i)))
        picked = {c: _picked(c) for c in ("docs", "tf", "length")}
        some = rows.withColumn("keep", F.when(F.col("left").isNull(), F.transform("docs", lambda _, i: i)).otherwise(keep)).where(F.size("keep") > 0)
        picked["tf"] = F.when(F.col("tf").isNotNull(), picked["tf"]).alias("tf")
        some = some.select("segment", "term", "block", F.size("keep").alias("n"), F.when(F.col("term") == "", F.aggregate(picked["length"], F.lit(0), lambda a, x: a + x)).otherwise(F.col("max_tf")).alias("max_tf"), "min_length", *picked.values(), "ids")  # ids stay in the places of their numbers
        folder = self._write(some.repartition("segment").sortWithinPartitions("segment", "term", "block"))
        self.log._commit(base, StructType.fromJson(manifest["schema"]), {"segments": [folder]})

    # --- search --------------------------------------------------------------------------------

    def statistics(self) -> tuple[int, int]:
        """Documents that aren't dead, and their tokens."""
        if self._read("segments") is None:
            return 0, 0
        return self._frequencies([])[:2]

    def _frequencies(self, terms: list[str]) -> tuple[int, int, dict[str, int]]:
        """Documents that aren't dead, their tokens, and how many of them have each term that any has."""
        found = self._of_terms(self._read("segments"), ["", *terms]).groupBy("term").agg(F.sum("n").alias("n"), F.sum("max_tf").alias("t")).collect()
        df, total = {r["term"]: r["n"] for r in found}, sum(r["t"] for r in found if r["term"] == "")
        if "dead" in self.log._manifest()[1]["files"]:
            out = self._read("dead").agg(F.sum(F.size("docs")).alias("n"), F.sum("length").alias("t")).first()
            total, df[""] = total - out["t"], df[""] - out["n"]
            for r in self._of_terms(self._read("gone"), terms).groupBy("term").agg(F.sum("n").alias("n")).collect() if terms else ():
                df[r["term"]] -= r["n"]
        return df.pop("", 0), total, {t: c for t, c in df.items() if c > 0}

    def _of_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        if len(terms) <= NAMED_TERMS:
            return rows.where(F.col("term").isin(terms))
        named = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        return rows.join(F.broadcast(named), "term", "left_semi")  # the terms of one block of queries

    def search(self, queries: DataFrame, k: int, among: DataFrame | None = None, k1: float = search.K1, b: float = search.B, block: int = search.TERM_BLOCK) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents of each query (query_id, text) by BM25, exactly.

        `among`, a table of doc_id, leaves only its documents; statistics are those of all. Ties go by id as a string.
        """
        id_type = self.log._manifest()[1]["schema"]
        kind = StructType.fromJson(id_type)["doc_id"].dataType.simpleString() if id_type else "string"
        query_kind = queries.schema["query_id"].dataType.simpleString()
        found = None
        asked = queries.select("query_id", T.search_terms("text").alias("terms"))
        for rows in search._slices(asked, block) if id_type else ():
            n, total, df = self._frequencies(sorted({t for r in rows for t in r["terms"]}))
            idf = {t: float(np.log1p((n - c + 0.5) / (c + 0.5))) for t, c in df.items()}
            if idf:
                part = self._search(rows, idf, k, total / n or 1.0, k1, b, query_kind, queries, among)
                found = part if found is None else found.union(part)
        if found is None:
            return self.spark.createDataFrame([], f"query_id {query_kind}, doc_id {kind}, score double, rank int")
        ids = self._read("segments").where("term = ''").select("segment", "ids")
        named = found.join(ids, "segment").select("query_id", F.get("ids", F.col("no")).alias("item_id"), "score")
        return search._ranked(named, k).withColumnRenamed("item_id", "doc_id")

    def _search(self, rows: list, idf: dict[str, float], k: int, mean: float, k1: float, b: float, kind: str, queries: DataFrame, among: DataFrame | None) -> DataFrame:
        sent = self.spark.sparkContext.broadcast((search._ids(rows, queries), [[(t, idf[t]) for t in r["terms"] if t in idf] for r in rows]))
        blocks = self._of_terms(self._read("segments"), sorted(idf)).select("segment", "term", "block", "max_tf", "min_length", "docs", "tf", "length")
        none = [F.lit(None).cast(blocks.schema[c].dataType).alias(c) for c in ("max_tf", "min_length", "tf", "length")]
        if self.log._manifest()[1]["files"].get("dead"):
            dead = self._read("dead").select("segment", F.lit(None).cast("string").alias("term"), F.lit(-2).alias("block"), "docs", *none)
            blocks = blocks.unionByName(dead.select(*blocks.columns))
        if among is not None:
            live = self._live()
            wanted = live.join(among.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("segment").agg(F.collect_list("no").alias("docs"))
            wanted = live.select("segment").distinct().join(wanted, "segment", "left").withColumn("docs", F.coalesce("docs", F.array().cast("array<int>")))
            blocks = blocks.unionByName(wanted.select("segment", F.lit(None).cast("string").alias("term"), F.lit(-1).alias("block"), "docs", *none).select(*blocks.columns))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, asked = sent.value
            best = [_Heap(k) for _ in asked]
            for _, own in groupby(_rows(batches), lambda r: r[0]):
                _search_segment(list(own), asked, best, mean, k1, b)
            out = [(q, *hit) for q, heap in enumerate(best) for hit in heap.hits]
            if out:
                q, score, segment, no = zip(*out)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(segment, pa.string()), pa.array(no, pa.int32()), pa.array(score, pa.float64())], names=["query_id", "segment", "no", "score"])

        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return blocks.repartition(parts, "segment").sortWithinPartitions("segment", F.col("term").asc_nulls_first(), "block").mapInArrow(run, f"query_id {kind}, segment string, no int, score double")


def _picked(column: str) -> Column:
    """The elements of an array column at the places in `keep`."""
    return F.transform("keep", lambda i: F.get(column, i)).alias(column)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        segment, term, block, max_tf, min_length = (b.column(i).to_pylist() for i in range(5))
        docs, tf, length = (b.column(i) for i in range(5, 8))
        flat = [(c.values.to_numpy(zero_copy_only=False), np.asarray(c.offsets)) for c in (docs, tf, length)]
        for i in range(b.num_rows):
            yield segment[i], term[i], block[i], max_tf[i], min_length[i], *(v[o[i] : o[i + 1]] for v, o in flat)


class _Heap:
    """The k best (score, segment, no) of a query over the segments of a task, with all that tie with the last of them."""

    def __init__(self, k: int):
        self.k, self.floor, self.hits = k, 0.0, []

    def add(self, scores: np.ndarray, segment: str, docs: np.ndarray) -> None:
        if len(scores) > self.k:  # within a segment ties go by number, which follows the id
            edge = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            above, tied = np.flatnonzero(scores > edge), np.flatnonzero(scores == edge)
            take = np.r_[above, tied[np.argsort(docs[tied], kind="stable")][: self.k - len(above)]]
            scores, docs = scores[take], docs[take]
        self.hits += zip(scores.tolist(), [segment] * len(docs), docs.tolist())
        if len(self.hits) >= self.k:
            self.floor = sorted((h[0] for h in self.hits), reverse=True)[self.k - 1]
            self.hits = [h for h in self.hits if h[0] >= self.floor]


def _search_segment(rows: list[tuple], asked: list[list[tuple[str, float]]], best: list[_Heap], mean: float, k1: float, b: float) -> None:
    segment, terms, hidden, wanted = rows[0][0], {}, [], None
    for term, own in groupby(rows, lambda r: r[1]):
        own = list(own)
        if term is None:
            hidden = np.concatenate([r[5] for r in own if r[2] == -2] or [np.zeros(0, np.int32)])
            wanted = next((r[5] for r in own if r[2] == -1), None)
            continue
        docs, tf, length = (np.concatenate([r[i] for r in own]) for i in (5, 6, 7))
        impact = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))
        top, short = np.array([r[3] for r in own]), np.array([r[4] for r in own])
        edges = np.cumsum([0, *(len(r[5]) for r in own)])
        terms[term] = docs, impact, top * (k1 + 1) / (top + k1 * (1 - b + b * short / mean)), edges
    if not terms:
        return
    n = 1 + max(int(t[0][-1]) for t in terms.values())
    open_ = np.ones(n, bool) if wanted is None else np.zeros(n, bool)
    if wanted is not None:
        open_[wanted[wanted < n]] = True
    open_[np.asarray(hidden, np.int64)[np.asarray(hidden) < n]] = False
    for heap, query in zip(best, asked):
        own = sorted(((w * terms[t][2].max(), w, t) for t, w in query if t in terms), reverse=True)
        rest = sum(u for u, _, _ in own)
        least = heap.floor - 1e-9  # scores are rounded before they are compared
        if not own or rest <= least:
            continue
        candidates, total = open_.copy() if heap.floor <= 0 else np.zeros(n, bool), rest
        if heap.floor > 0:
            for upper, w, t in own:  # terms whose documents may still be among the best by what is left of the bounds
                if rest <= least:
                    break
                docs, _, bound, edges = terms[t]
                near = np.flatnonzero(w * bound + total - upper > least)
                for x in near if len(near) < len(bound) else ():
                    candidates[docs[edges[x] : edges[x + 1]]] = True
                if len(near) == len(bound):
                    candidates[docs] = True
                rest -= upper
            candidates &= open_
            if not candidates.any():
                continue
        score = np.zeros(n)
        for _, w, t in own:
            docs, impact, _, _ = terms[t]
            score[docs] += w * impact
        at = np.flatnonzero(candidates & (score > 0))
        value = score[at].round(9)
        keep = value >= max(heap.floor, 1e-9)
        if keep.any():
            heap.add(value[keep], segment, at[keep])
