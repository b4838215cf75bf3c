"""Stored indexes of vectors: 8-bit codes in inverted lists with exact rescoring, and a graph of nearest neighbours.

Codes: a unit vector's dimension is one of 256 steps between that dimension's least and greatest value.
With each row stands how far its code lies from it, so a product with the codes bounds the exact one from
both sides. A search scans codes, an eighth of doubles, keeps what can still be among the k best, and
scores that by the exact vectors of its lists. With all lists probed it is exact.

Graph: each item's nearest neighbours as rows of edges, found by looking at neighbours of neighbours, from
neighbours along random projections on. A search is a bounded number of rounds of joins: of each query's
best candidates those not yet opened are joined with their edges, and what is new is scored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import search
from tessera.runtime import shared_path, ship

_CODED = "list_id int, item_id {}, code binary, error double"


def _unit(column: pa.Array, width: int) -> np.ndarray:
    return search._vectors(column, width)


def _stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_lists(index: DataFrame) -> DataFrame:
    """An inverted-file index (as `search.ivf_index` gives it) written to the shared folder by lists, and read back."""
    path = shared_path(index.sparkSession, "lists")
    index.write.partitionBy("list_id").parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


# --- codes -------------------------------------------------------------------------------------


def _edges(items: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each dimension over all unit vectors; a row of each comes from a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(width, np.inf), np.full(width, -np.inf)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                x = _unit(b.column(0).slice(lo, 4096), width)
                if len(x):
                    low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        dims = np.flatnonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(low[dims]), pa.array(high[dims])], names=["d", "low", "high"])

    low, high = np.zeros(width), np.zeros(width)
    for r in items.select("vector").mapInArrow(run, "d long, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["d"]], high[r["d"]] = r["low"], r["high"]
    return low, high


class CodedIndex:
    """An inverted-file index of 8-bit codes in a folder: codes and vectors by list, and a row with centres and steps."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def build(self, items: DataFrame, lists: int, sample: int = 20_000) -> CodedIndex:
        """Indexes every item (item_id, vector). Centres are fitted on `sample` vectors at most; steps are those of all.

        The width is the commonest of the sample. Null, zero and other-width vectors are stored as zeros: similarity 0 to all.
        """
        ship(self.spark)
        centres = search.centroids(items, lists, sample)
        width = centres.shape[1]
        low, high = _edges(items, width)
        step = np.where(high > low, (high - low) / 255, 1.0)
        sent = self.spark.sparkContext.broadcast((centres, low, step))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, low, step = sent.value
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    x = _unit(part.column("vector"), width)
                    code = np.clip(np.rint((x - low) / step), 0, 255).astype(np.uint8)
                    error = np.linalg.norm(x - (low + code * step), axis=1)
                    of = (x @ centres.T).argmax(axis=1).astype(np.int32) if len(x) else np.zeros(0, np.int32)
                    cols = [pa.array(of), part.column("item_id"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(error), part.column("vector")]
                    yield pa.RecordBatch.from_arrays(cols, names=["list_id", "item_id", "code", "error", "vector"])

        kind = items.schema["item_id"].dataType.simpleString()
        coded = items.select("item_id", "vector").mapInArrow(run, _CODED.format(kind) + f", vector {items.schema['vector'].dataType.simpleString()}")
        coded.write.partitionBy("list_id").parquet(f"{self.path}/items")
        about = json.dumps({"centres": centres.tolist(), "low": low.tolist(), "step": step.tolist(), "kind": kind, "vector": items.schema["vector"].dataType.simpleString()})
        self.spark.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{self.path}/about")
        return self

    def _about(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/about").first()[0])

    def items(self) -> DataFrame:
        about = self._about()
        return self.spark.read.schema(f"item_id {about['kind']}, code binary, error double, vector {about['vector']}, list_id int").parquet(f"{self.path}/items")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, block: int = search.QUERY_BLOCK) -> DataFrame:
        """query_id, item_id, score, rank: the k nearest items of each query (query_id, vector) in the lists of its `probes` nearest centres, or in all."""
        ship(self.spark)
        about, found = self._about(), None
        centres, low, step = (np.array(about[c]) for c in ("centres", "low", "step"))
        every = probes is None or probes >= len(centres)
        items = self.items()
        kinds = search._kinds(items, queries, "item_id")
        for rows in search._slices(queries.select("query_id", "vector"), block):
            q = _unit(pa.array([r["vector"] for r in rows], pa.list_(pa.float64())), centres.shape[1])
            probed = np.ones((len(centres), len(q)), bool)
            if not every:
                near = np.argpartition(-(q @ centres.T), probes - 1, axis=1)[:, :probes]
                probed[:] = False
                probed[near.ravel(), np.repeat(np.arange(len(q)), probes)] = True
            sent = self.spark.sparkContext.broadcast((search._ids(rows, queries), q, probed, low, step))

            def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                ids, q, probed, low, step = sent.value
                kept = _Bounded(len(q), k)
                scaled, base = q * step, q @ low
                for b in batches:
                    for lo in range(0, b.num_rows, max(64, search.TILE // max(1, len(q)))):
                        part = b.slice(lo, max(64, search.TILE // max(1, len(q))))
                        code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                        about = scaled @ code.T.astype(float) + base[:, None]
                        kept.add(about, np.asarray(part.column("error")), probed[np.asarray(part.column("list_id"))].T, part.column("item_id"), np.asarray(part.column("list_id")))
                yield from kept.batches(ids)

            wanted = [int(x) for x in np.flatnonzero(probed.any(axis=1))]
            own = items.where(F.col("list_id").isin(wanted))
            scanned = _stored(own.select("list_id", "item_id", "code", "error").mapInArrow(run, kinds.replace("score double", "list_id int, lower double, upper double")), "bounds")
            floor = scanned.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lower")))).where(F.col("n") == k).select("query_id", F.col("lower").alias("floor"))
            left = scanned.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor"))).select("query_id", "list_id", "item_id")
            exact = own.select("list_id", "item_id", "vector").join(left, ["list_id", "item_id"])
            part = exact.select("query_id", "item_id", "vector").mapInArrow(_scored(sent), kinds)
            found = part if found is None else found.union(part)
        if found is None:
            found = self.spark.createDataFrame([], kinds)
        return search._ranked(found, k)


def _scored(sent):
    """Exact scores of pairs (query_id, item_id, vector)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value[:2]
        place = {x: i for i, x in enumerate(ids.to_pylist())}
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                at = np.array([place[x] for x in part.column("query_id").to_pylist()], np.int64)
                score = np.einsum("ij,ij->i", q[at], _unit(part.column("vector"), q.shape[1])).round(12)
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("item_id"), pa.array(score)], names=["query_id", "item_id", "score"])

    return run


class _Bounded:
    """Items whose upper bound reaches the k-th best lower bound of their query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.query, self.lower, self.upper, self.at, self.of = (np.zeros(0, t) for t in (np.int64, float, float, np.int64, np.int32))
        self.items, self.seen = [], 0

    def add(self, score: np.ndarray, error: np.ndarray, open_: np.ndarray, items: pa.Array, lists: np.ndarray) -> None:
        """score: queries x items, true within error; open_: which of them count."""
        slack = error + 1e-9
        query, item = np.nonzero(open_ & (score + slack >= self.floor[:, None]))
        if not len(query):
            return
        used, place = np.unique(item, return_inverse=True)
        self.items.append(items.take(pa.array(used)))
        self.query, self.at, self.of = np.r_[self.query, query], np.r_[self.at, place + self.seen], np.r_[self.of, lists[item]]
        self.lower, self.upper = np.r_[self.lower, score[query, item] - slack[item]], np.r_[self.upper, score[query, item] + slack[item]]
        self.seen += len(used)
        order = np.lexsort((-self.lower, self.query))
        q = self.query[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        last = first + self.k - 1
        enough = last < np.r_[first[1:], len(q)]
        self.floor[q[first[enough]]] = self.lower[order[last[enough]]]
        keep = self.upper >= self.floor[self.query]
        self.query, self.lower, self.upper, self.at, self.of = (v[keep] for v in (self.query, self.lower, self.upper, self.at, self.of))
        if self.seen > 4 * len(self.at) + 4096:
            used, self.at = np.unique(self.at, return_inverse=True)
            self.items, self.seen = [pa.concat_arrays(self.items).take(pa.array(used))], len(used)

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        if len(self.query):
            cols = [ids.take(pa.array(self.query)), pa.concat_arrays(self.items).take(pa.array(self.at)), pa.array(self.of), pa.array(self.lower), pa.array(self.upper)]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "item_id", "list_id", "lower", "upper"])


# --- a graph -----------------------------------------------------------------------------------


def _along(items: DataFrame, width: int, steps: int, seed: int) -> DataFrame:
    """src, dst, score of items that follow each other by a random projection, `steps` apart at most; `far` tells those that are next to each other."""
    axis = np.random.default_rng(seed).standard_normal(width)

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_unit(part.column("vector"), width) @ axis)], names=["item_id", "vector", "at"])

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last rows of the batch before
        for b in batches:
            rows = pa.Table.from_batches([b] if before is None else [before, b]).combine_chunks()
            x, ids = _unit(rows.column("vector").combine_chunks(), width), rows.column("item_id").combine_chunks()
            n, skip = len(ids), 0 if before is None else before.num_rows
            i = np.concatenate([np.arange(max(0, skip - d), max(max(0, skip - d), n - d)) for d in range(1, steps + 1)])
            j = i + np.concatenate([np.full(max(0, n - d - max(0, skip - d)), d) for d in range(1, steps + 1)])
            score = np.einsum("ij,ij->i", x[i], x[j]).round(12)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.r_[i, j])), ids.take(pa.array(np.r_[j, i])), pa.array(np.r_[score, score]), pa.array(np.r_[j - i, j - i] == 1)], names=["src", "dst", "score", "far"])
            before = rows.slice(max(0, n - steps)).to_batches()[0] if n else None

    kind, vector = (items.schema[c].dataType.simpleString() for c in ("item_id", "vector"))
    laid = items.mapInArrow(project, f"item_id {kind}, vector {vector}, at double")
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = laid.repartitionByRange(parts, "at", "item_id").sortWithinPartitions("at", "item_id").select("item_id", "vector")
    return laid.mapInArrow(link, f"src {kind}, dst {kind}, score double, far boolean")


def _nearest(edges: DataFrame, degree: int, by: str = "src") -> DataFrame:
    """The `degree` best of distinct edges of each node."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.col("dst" if by == "src" else "src").cast("string"))
    return edges.withColumn("n", F.row_number().over(order)).where(F.col("n") <= degree).drop("n")


def _distinct(edges: DataFrame) -> DataFrame:
    """Distinct edges, dealt out by src alone, so that what follows by src shuffles nothing again."""
    return edges.select("src", "dst", "score").repartition("src").groupBy("src", "dst").agg(F.max("score").alias("score"))


def neighbour_graph(items: DataFrame, degree: int = 16, rounds: int = 3, projections: int = 4, seed: int = 5) -> DataFrame:
    """src, dst, score, near: about the `degree` nearest items of each item (item_id, vector), every item being in it.

    Edges that aren't near lead to the next items along each projection, two or fewer each way: without them the
    groups of clustered vectors have no way from one to another.

    A round joins each item with the vectors of its nearest neighbours both ways, `degree` each way, and
    scores them against one another: a group has 2 * degree + 1 rows, however many items name one as
    their neighbour. Ids don't repeat; the width is the commonest of a sample.
    """
    ship(items.sparkSession)
    items = items.select("item_id", "vector")
    width = search._query_vectors(items.where("vector IS NOT NULL").limit(1000).collect()).shape[1]
    kind, vector = (items.schema[c].dataType.simpleString() for c in ("item_id", "vector"))
    paths = None
    for p in range(projections):
        part = _along(items, width, max(2, degree // 4), seed + p)
        paths = part if paths is None else paths.union(part)
    edges = paths = _stored(paths, "paths")

    def groups(rows: pa.Table, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Edges among the rows of each group, in tiles of groups: of each row the best, down to what it has."""
        ids, floor = rows.column("item_id").combine_chunks(), np.asarray(rows.column("floor").combine_chunks())
        vector, m = rows.column("vector").combine_chunks(), int(size.max())
        step = max(1, search.TILE // (m * max(m, width)))
        for lo in range(0, len(start), step):
            first, own = int(start[lo]), size[lo : lo + step]
            n = int(own.sum())
            group, at = np.repeat(np.arange(len(own)), own), np.arange(n) - np.repeat(np.cumsum(own) - own, own)
            x = np.zeros((len(own), m, width))
            x[group, at] = _unit(vector.slice(first, n), width)
            score = (x @ x.transpose(0, 2, 1)).round(12)
            score[np.broadcast_to(np.arange(m) >= own[:, None, None], score.shape)] = -np.inf
            score[:, np.arange(m), np.arange(m)] = -np.inf
            score = score[group, at]
            near = np.argsort(-score, axis=1, kind="stable")[:, :degree]
            value = np.take_along_axis(score, near, axis=1)
            i, j = np.nonzero(np.isfinite(value) & (value >= floor[first : first + n, None]))
            other = first + i - at[i] + near[i, j]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first + i)), ids.take(pa.array(other)), pa.array(value[i, j])], names=["src", "dst", "score"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group, which may go on
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            mid = np.asarray(rows.column("mid").combine_chunks().dictionary_encode().indices)
            start = np.flatnonzero(np.r_[True, mid[1:] != mid[:-1]])
            if len(start) > 1:
                yield from groups(rows, start[:-1], np.diff(start))
            held = rows.slice(int(start[-1]))
        if held is not None:
            yield from groups(held, np.zeros(1, np.int64), np.array([held.num_rows]))

    for _ in range(rounds):
        edges = _stored(_nearest(_distinct(edges), degree), "graph")
        # An edge below an item's `degree` best so far is never among them again, so it isn't sent.
        floor = edges.groupBy(F.col("src").alias("item_id")).agg(F.when(F.count(F.lit(1)) >= degree, F.min("score")).alias("floor"))
        known = items.join(floor, "item_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        back = _nearest(edges, degree, "dst").select(F.col("dst").alias("mid"), F.col("src").alias("item_id"))
        around = edges.select(F.col("src").alias("mid"), F.col("dst").alias("item_id")).union(back).union(items.select(F.col("item_id").alias("mid"), "item_id")).distinct()
        met = around.join(known, "item_id").select("mid", "item_id", "vector", "floor").repartition("mid").sortWithinPartitions("mid")
        edges = edges.union(met.mapInArrow(meet, f"src {kind}, dst {kind}, score double"))
    near = _nearest(_distinct(edges), degree).withColumn("near", F.lit(True))
    far = paths.where("far").select("src", "dst", "score").withColumn("near", F.lit(False))
    return _stored(near.unionByName(far).groupBy("src", "dst").agg(F.max("score").alias("score"), F.max("near").alias("near")), "graph")


def graph_search(edges: DataFrame, items: DataFrame, queries: DataFrame, k: int, beam: int = 64, width: int = 16, rounds: int = 8, entries: int = 64) -> DataFrame:
    """query_id, item_id, score, rank: about the k nearest items of each query (query_id, vector) by a walk over the graph.

    Walks begin at `entries` items, those with the least hashes. A round opens the `width` best of the `beam` best
    candidates that aren't opened, along edges in both directions; it ends after `rounds` rounds, or when no query
    has any to open. What is kept of a query are its `beam` best (k at least): a candidate that isn't among them
    never is again, and is scored again where it is met again.
    """
    spark = items.sparkSession
    ship(spark)
    items = items.select("item_id", "vector")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = _stored(both, "both-ways")
    q = queries.select("query_id", F.col("vector").alias("asked"))
    start = items.orderBy(F.xxhash64(F.lit(3), "item_id"), F.col("item_id").cast("string")).limit(entries)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, score double"

    def scored(pairs: DataFrame) -> DataFrame:
        """pairs: query_id, item_id, asked, vector."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = b.slice(lo, 4096)
                    asked = part.column("asked")
                    width = max(np.diff(np.asarray(asked.offsets)), default=0)
                    score = np.einsum("ij,ij->i", _unit(asked, int(width)), _unit(part.column("vector"), int(width))).round(12)
                    yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("item_id"), pa.array(score)], names=["query_id", "item_id", "score"])

        return pairs.select("query_id", "item_id", "asked", "vector").mapInArrow(run, kinds)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("item_id").cast("string"))
    kept = max(beam, k)

    def held(candidates: DataFrame) -> DataFrame:
        return _stored(candidates.withColumn("n", F.row_number().over(best)).where(F.col("n") <= kept), "walk")

    # Entry items are `entries` rows at most.
    seen = held(scored(q.join(F.broadcast(start))).withColumn("opened", F.lit(False)))
    for _ in range(rounds):
        closed = seen.where((F.col("n") <= beam) & ~F.col("opened"))
        ahead = _stored(closed.withColumn("m", F.row_number().over(best)).where(F.col("m") <= width).select("query_id", "item_id"), "ahead")
        if ahead.isEmpty():
            break
        reached = ahead.join(both.withColumnRenamed("src", "item_id"), "item_id").select("query_id", F.col("dst").alias("item_id")).distinct()
        new = reached.join(seen, ["query_id", "item_id"], "left_anti")
        found = scored(new.join(items, "item_id").join(q, "query_id")).withColumn("opened", F.lit(False))
        now = seen.join(ahead.withColumn("now", F.lit(True)), ["query_id", "item_id"], "left").select("query_id", "item_id", "score", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"))
        seen = held(now.unionByName(found))
    return search._ranked(seen.drop("opened", "n"), k)
