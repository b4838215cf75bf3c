"""Operator 11, source divergence audit: how far the term distributions of a language's sources lie apart.

Terms are counted per Arrow batch, then by Spark. The vocabulary of a language is cut into chunks by hash
and numbered within them, and a source's counts of a chunk become one packed vector. Sources
are dealt into blocks; each vector is replicated to the tiles of its block (two blocks of sources, a span
of chunks), and a task walks over a tile's chunks in order and holds one chunk at a time. All tiles of a
pair are then added up. Terms that neither block has are not looked at: each adds the same to a pair, so
they come in once, by their number.

All arithmetic is in whole numbers: shares are parts of 1,000,000,000, rounded down after an exact long
division in steps of 1,000, so counts and denominators up to 9e15 don't overflow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import blocks, cut, owner, table
from tessera.llm.terms import LETTERS, attached, encoded
from tessera.runtime import ship

LEAST_DOCS, TOP_TERMS = 3, 200
CHUNK_TERMS, SPAN_CHUNKS, BLOCK_SOURCES = 4096, 8, 64


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), n_docs (rows that have it) of docs (text, lang, source without nulls)."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources = (b.column(c).dictionary_encode() for c in ("lang", "source"))
            group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            for lo, hi, data, offs in blocks(b.column("text"), 1 << 23):
                ids, words, firsts = encoded(data, offs, LETTERS)
                if not len(ids):
                    continue
                seen, n = np.unique(owner(firsts) * len(words) + ids, return_counts=True)
                keys = group[lo:hi][seen // len(words)] * len(words) + seen % len(words)
                order = np.argsort(keys, kind="stable")
                keys, first = np.unique(keys[order], return_index=True)
                of = keys // len(words)
                cols = [langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))), words.take(pa.array(keys % len(words)))]
                cols += [pa.array(np.add.reduceat(n[order], first)), pa.array(np.diff(np.r_[first, len(order)]))]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "n_docs"])

    partial = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, n_docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total), exact."""
    out, rest = 0, count + 1
    for _ in range(3):
        whole, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + whole
    return out + 1


def share(count: Column, total: Column) -> Column:
    """As shares, of columns named by count and total."""
    out, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return out + 1


def _tile(rows: Iterator[tuple]) -> tuple[list[str], list[int], np.ndarray]:
    """Sources of a tile, their blocks, and value[i, j] of source i against source j, both in the tile's span.

    rows are sorted by chunk: (.., span, chunk, block, source, total, terms, ids, counts); chunk -1 names all sources.
    """
    names: list[tuple[int, str]] = []
    value = p0 = f0 = None
    for chunk, members in groupby(rows, itemgetter(4)):
        if chunk < 0:
            heads = sorted((r[5], r[6], r[7], r[8], r[3]) for r in members)
            names, total = [h[:2] for h in heads], np.array([h[2] for h in heads], np.int64)
            terms = heads[0][3]
            p0 = shares(np.zeros(len(total), np.int64), np.maximum(total, 1))
            f0 = (p0[:, None] - p0) ** 2 // p0
            value = f0 * terms if heads[0][4] == 0 else np.zeros_like(f0)  # terms of all chunks, counted in the first span
            place = {name: i for i, name in enumerate(names)}
            continue
        members = [(place[r[5], r[6]], r[9], r[10]) for r in members]
        union = np.unique(np.concatenate([ids for _, ids, _ in members]))
        counts = np.zeros((len(names), len(union)), np.int64)
        for i, ids, n in members:
            counts[i, np.searchsorted(union, ids)] = n
        p = shares(counts, total[:, None])
        for i in range(len(names)):
            value[i] += ((p[i] - p) ** 2 // p).sum(axis=1)
        value -= f0 * len(union)
    return [s for _, s in names], [b for b, _ in names], value


def _tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            plain = [b.column(k).to_pylist() for k in range(9)]
            ids, counts = b.column(9), b.column(10)
            for k, row in enumerate(zip(*plain)):
                yield (*row, ids[k].values.to_numpy() if ids[k].is_valid else None, counts[k].values.to_numpy() if counts[k].is_valid else None)

    for (lang, a, b, _), found in groupby(rows(), itemgetter(0, 1, 2, 3)):
        sources, of, value = _tile(found)
        i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
        if a != b:
            other = np.array(of)[i] != np.array(of)[j]
            i, j = i[other], j[other]
        names = pa.array(sources, pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(i), pa.string()), names.take(pa.array(i)), names.take(pa.array(j)), pa.array(value[i, j])], names=["lang", "source", "item", "value"])


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, chunk_terms: int = CHUNK_TERMS, span_chunks: int = SPAN_CHUNKS, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """lang, source, part, item, value, rank of docs (text, lang, source; a null in any counts as '').

    A language keeps the terms of at least `least_docs` of its rows. Part `pair`: how far a source is
    from each other source (item) of the language over all kept terms; part `term`: the source's `top`
    terms by how much more of it they make up than of the language. Ranks go by value, then item. A
    source without terms counts as one with none of them; a language without kept terms has pairs of
    value 0 and no terms, and an empty table gives no rows. Repeated rows count as often as they occur.
    """
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = cut(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut(kept, "kept-terms")
    groups = docs.select("lang", "source").distinct()

    per_lang = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources")).join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total")), "lang", "left")
    upto = lambda n, size: F.ceil(F.col(n) / size)
    per_lang = per_lang.fillna(0, ["v", "lang_total"]).withColumn("chunks", F.greatest(upto("v", chunk_terms), F.lit(1)))
    per_lang = cut(per_lang.withColumn("spans", upto("chunks", span_chunks)).withColumn("blocks", upto("n_sources", block_sources)), "langs")

    chunked = attached(kept, per_lang.select("lang", "chunks"), ["lang"]).withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    vocabulary = chunked.withColumn("id", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term"))).drop("chunks")
    used = cut(counts.drop("n_docs").join(vocabulary, ["lang", "term"]), "kept-counts")
    groups = groups.join(used.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left").fillna(0, ["n"])
    groups = attached(groups, per_lang, ["lang"]).withColumn("total", F.col("n") + F.col("v")).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    groups = cut(groups.drop("n"), "sources")

    pairs = _pairs(used, groups, span_chunks)
    wide = attached(used, groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    p, q = F.col("p"), F.col("q")
    wide = wide.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("v")).alias("q"))
    above = wide.where(p > q).select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), q).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    parts = [x.withColumn("rank", place).withColumn("part", F.lit(name)) for x, name in ((pairs, "pair"), (above, "term"))]
    return parts[0].unionByName(parts[1].where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def _pairs(used: DataFrame, groups: DataFrame, span_chunks: int) -> DataFrame:
    """lang, source, item, value: tiles of source blocks by source blocks, each over a span of chunks."""
    vectors = used.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("packed"))  # one chunk's terms at most
    vectors = attached(vectors, groups.where("n_sources > 1").select("lang", "source", "block", "blocks", "total", "v"), ["lang", "source"])
    vectors = vectors.where(F.col("block").isNotNull()).withColumn("span", F.floor(F.col("chunk") / span_chunks).cast("int"))
    heads = groups.where("n_sources > 1").withColumn("span", F.explode(F.sequence(F.lit(0), F.col("spans").cast("int") - 1))).withColumn("chunk", F.lit(-1))
    rows = vectors.unionByName(heads.select("lang", "source", "block", "blocks", "total", "v", "span", "chunk"), allowMissingColumns=True)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    tile = ["lang", "a", "b", "span"]
    rows = rows.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other"))
    rows = rows.select(*tile, "chunk", "block", "source", "total", "v", F.col("packed.id").alias("ids"), F.col("packed.n").alias("counts"))
    found = rows.repartition(*tile).sortWithinPartitions(*tile, "chunk").mapInArrow(_tiles, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of all sources of each language of `documents`; see divergences."""
    return divergences(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
used AS MATERIALIZED (SELECT d, lang, source, term, count(*) AS n FROM (SELECT d, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM used GROUP BY ALL HAVING count(*) >= 3),
langs AS (SELECT lang, sum(n) AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, source, term, sum(u.n)::HUGEINT AS n FROM used u SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
groups AS MATERIALIZED (SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals t USING (lang, source)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + l.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (l.total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM terms QUALIFY rank <= 200
"""
