"""Operator 5, mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Each source's documents are dealt into shards by a seeded hash of doc_id and lie one after another
there in a seeded order; a shard's words are cut into blocks of `block` words. All blocks of the
mix are seats that go to sources by highest quotient target / (2 * seats + 1), then a source's seats
go to its shards in the same way. A shard takes whole passes over its blocks and, for the rest of
its quota, the blocks that a seeded permutation puts first. The permutation is affine (a * j + b
mod n, a coprime to n), so whether a block is taken needs no sort and no row per block.

Only sums come to the driver: a row per source and a row per shard. A source has at most 4,096
shards, however large it is, so that is bounded by the number of sources, not of documents.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, cut, table

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 19
MOST_SHARDS = 4096


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, cap: float) -> list[float]:
    """Shares of `total` by weight, none over cap * size; the excess goes to the others by weight."""
    target = [0.0] * len(sizes)
    free, left = [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if per * weights[i] >= cap * sizes[i]]
        if not full:
            for i in free:
                target[i] = per * weights[i]
            break
        for i in full:
            target[i] = float(cap * sizes[i])
            left -= target[i]
        free = [i for i in free if i not in set(full)]
    return target


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 * s + 1); ties to the earlier; none over `most`."""
    most = [seats] * len(votes) if most is None else list(most)
    seats = min(seats, sum(m for v, m in zip(votes, most) if v > 0))
    if not seats:
        return [0] * len(votes)
    low, high = 0.0, 2.0 * max(votes) + 1.0  # a divisor near which the quotients used end
    for _ in range(200):
        mid = (low + high) / 2
        if sum(min(m, math.floor(v / mid + 0.5)) for v, m in zip(votes, most) if v > 0) > seats:
            low = mid
        else:
            high = mid
    got = [min(m, math.floor(v / high + 0.5)) if v > 0 else 0 for v, m in zip(votes, most)]
    queue = [(-v / (2 * s + 1), i) for i, (v, s, m) in enumerate(zip(votes, got, most)) if v > 0 and s < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """What a mix takes of each document (doc_id, text, source).

    Returns doc_id, source, size, source_size, target (of the source), passes (whole ones over the
    document's shard), taken. Sources are put in order by code point, null last, and get `weights`,
    repeating. A null text has size 0, and what has size 0 is never taken. Rows that share a doc_id
    are documents of their own. The same rows give the same mix, in whatever order they come.
    Empty tables and tables without a word give targets of 0.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    # A row without doc_id is dealt out and ordered by its text, so those of a source don't share one shard.
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("key")
    sized = cut(docs.select("doc_id", "source", size.alias("size"), key), "mix")

    sums = sized.groupBy("source").agg(F.sum("size").alias("n")).collect()
    sums = sorted(((r["source"], r["n"]) for r in sums), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [n for _, n in sums]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sums))], share * sum(sizes), cap)
    counts = [max(1, min(MOST_SHARDS, -(-n // shard_words))) for n in sizes]
    plan = spark.createDataFrame([(s, n, t, c) for (s, n), t, c in zip(sums, targets, counts)], "source string, source_size long, target double, n_shards int")

    def same(a: DataFrame, b: DataFrame):
        return a["source"].eqNullSafe(b["source"])

    dealt = sized.join(plan, same(sized, plan), "left").drop(plan["source"])
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "key"), F.col("n_shards")).cast("int"))
    shards: dict[int, list[tuple[int, int]]] = {}
    place = {s: i for i, (s, _) in enumerate(sums)}
    for r in dealt.groupBy("source", "shard").agg(F.sum("size").alias("n")).collect():
        shards.setdefault(place[r["source"]], []).append((r["shard"], r["n"]))

    blocks = {i: [-(-n // block) for _, n in sorted(own)] for i, own in shards.items()}
    every = [sum(blocks.get(i, ())) for i in range(len(sums))]
    seats = sainte_lague(targets, round(sum(targets) / block), [int(cap * b) for b in every])
    quotas = []
    for i, own in shards.items():
        own = sorted(own)
        got = sainte_lague([n for _, n in own], seats[i], [int(cap * b) for b in blocks[i]])
        for (shard, _), b, quota in zip(own, blocks[i], got):
            rng = random.Random(f"{seed}/{i}/{shard}")
            a = next(x for x in iter(lambda: rng.randrange(1, max(2, b)), None) if math.gcd(x, b) == 1)
            quotas.append((sums[i][0], shard, max(1, b), quota // max(1, b), quota % max(1, b), a, rng.randrange(max(1, b))))
    plans = spark.createDataFrame(quotas, "source string, shard int, n_blocks long, passes long, rest long, a long, b long")

    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "key"), "doc_id", "key", "size")
    laid = dealt.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    on = same(laid, plans) & (laid["shard"] == plans["shard"])
    laid = laid.join(plans, on, "left").drop(plans["source"]).drop(plans["shard"])
    part = F.expr(
        f"""CASE WHEN size = 0 OR rest = 0 THEN 0L ELSE aggregate(sequence(start DIV {block}, (end - 1) DIV {block}), 0L,
        (acc, j) -> acc + IF((a * j + b) % n_blocks < rest, least(end, (j + 1) * {block}) - greatest(start, j * {block}), 0L)) END"""
    )
    return laid.withColumn("taken", F.col("passes") * F.col("size") + part).select("doc_id", "source", "size", "source_size", "target", "passes", "taken")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150 % of all words takes of each row of `documents`; see mix_sources."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
