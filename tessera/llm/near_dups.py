"""Operator 4, MinHash near-duplicates with odd sketches.

1. Per document, in numpy: its set of word shingles, a digest of the set, MinHash samples, band
   keys, and two odd sketches: the samples, and the whole set, folded into parity bitmaps.
2. Documents with equal sets are one class, so copies cost a row each and no more.
3. Candidates are classes that share a band. A bucket of up to SMALL classes gives its pairs, a
   larger one links each member to its lead, the one whose buckets are largest together: the text
   that a group of copies derives from, if it is there. The XOR population count of two odd sketches
   of samples estimates the similarity. That of the sets' bitmaps never exceeds their symmetric
   difference, so it excludes pairs for certain, and sharply if the sets aren't much larger than the
   bitmaps. Only pairs that pass both go on to the check of the full sets.
4. Links become components. Members of a large bucket that are not in one component yet are then
   compared with those of the other components there, so no link is lost, while members of one
   component are never paired with each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, cut, free_shuffles, gram_hash, mix, owner, prefix_hash, span_hash, table, word_spans
from tessera.llm.components import components
from tessera.runtime import ship

SKETCH_WORDS = 8
SET_WORDS = 16
SMALL = 8
WIDE = ["n_shingles", *(f"s{k}" for k in range(SKETCH_WORDS)), *(f"m{k}" for k in range(SET_WORDS))]


def banding(threshold: float, miss: float = 1e-7, most_bands: int = 32) -> tuple[int, int]:
    """(bands, rows): the most rows with which `most_bands` bands miss a pair at the threshold no more often than `miss`."""
    best = (most_bands, 1)
    for rows in range(1, 16):
        bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands <= most_bands:
            best = (max(1, bands), rows)
    return best


def odd_sketch_limit(threshold: float, samples: int, bits: int = 64 * SKETCH_WORDS) -> int:
    """Most bits in which the odd sketches of two sets at the threshold differ, six deviations allowed for.

    Of `samples` MinHash samples about (1 - J) differ; each puts one bit of its own into each
    sketch, and m such tosses leave bits / 2 * (1 - exp(-2 m / bits)) odd counts on average.
    """
    differ = min(samples, samples * (1 - threshold) + 6 * math.sqrt(samples * threshold * (1 - threshold)) + 1)
    return math.ceil(bits / 2 * (1 - math.exp(-4 * differ / bits)) + 3 * math.sqrt(differ))


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin.

    With fewer than n words, the whole sequence is the one shingle; without words there is none.
    """
    start, end, firsts = word_spans(data, offs)
    h = span_hash(prefix_hash(data, fold=True), start, end)
    grams, counts = gram_hash(h, n), np.diff(firsts)
    sets: list[np.ndarray] = []
    for k in np.arange(len(counts)):
        m, at = counts[k], firsts[k]
        if m >= n:
            sets.append(np.unique(grams[at : at + m - n + 1]))
        else:
            sets.append(mix(gram_hash(h[at : at + m], m) ^ np.uint64(m)) if m else h[:0])
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else h[:0], np.r_[0, np.cumsum(sizes)]


def min_hashes(values: np.ndarray, firsts: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """MinHash samples (samples x sets), of sets that are not empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2)
    out = np.full((samples, len(firsts) - 1), np.iinfo(np.uint64).max, np.uint64)
    lo, step = 0, 1 << 15  # values that stay in the cache
    while lo < len(firsts) - 1:
        hi = max(lo + 1, int(np.searchsorted(firsts, firsts[lo] + step, "right")) - 1)
        part, at = values[firsts[lo] : firsts[hi]], firsts[lo:hi] - firsts[lo]
        scratch = np.empty_like(part)
        for j in range(samples):
            np.multiply(part, a[j], out=scratch)
            np.add(scratch, b[j], out=scratch)
            out[j, lo:hi] = np.minimum.reduceat(scratch, at)
        lo = hi
    return out


def set_parity(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The odd sketch of each whole set: SET_WORDS numbers whose bits are parities of hash counts."""
    bits, n = 64 * SET_WORDS, len(firsts) - 1
    out = np.zeros((n, SET_WORDS), np.uint64)
    place = (mix(values ^ np.uint64(0x5E7)) & np.uint64(bits - 1)).astype(np.int64)
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        who = np.repeat(np.arange(hi - lo), np.diff(firsts[lo : hi + 1]))
        counts = np.bincount(who * bits + place[firsts[lo] : firsts[hi]], minlength=(hi - lo) * bits).reshape(hi - lo, bits)
        out[lo:hi] = np.packbits((counts & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, seed: int) -> DataFrame:
    """doc_id, n_shingles, d0 and d1 (digest of the set), bands, s0... and m0... (odd sketches of samples and set) of each row."""
    samples = bands * rows
    longs = ["d0", "d1", *WIDE[1:]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text")):
                values, firsts = shingle_sets(data, offs, n)
                sizes = np.diff(firsts)
                full = np.flatnonzero(sizes)
                out = {k: np.zeros(hi - lo, np.uint64) for k in longs}
                keys = np.zeros((hi - lo, bands), np.uint64)
                if len(full):
                    starts = np.r_[firsts[full], firsts[-1]]
                    sig = min_hashes(values, starts, samples, seed)
                    out["d0"][full] = np.add.reduceat(mix(values), starts[:-1])
                    out["d1"][full] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5)), starts[:-1]) ^ mix(sizes[full].astype(np.uint64))
                    for k in range(bands):
                        key = np.full(len(full), k + 1, np.uint64)
                        for j in range(rows):
                            key = key * np.uint64(0x9FB21C651E98DF25) + sig[k * rows + j]
                        keys[full, k] = mix(key)
                    bit = mix(sig + (np.arange(samples, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))[:, None])
                    words = (bit & np.uint64(SKETCH_WORDS - 1)).astype(np.int64)
                    ones = np.uint64(1) << (bit >> np.uint64(58))
                    for k in range(SKETCH_WORDS):
                        out[f"s{k}"][full] = np.bitwise_xor.reduce(np.where(words == k, ones, np.uint64(0)), axis=0)
                for k, column in enumerate(set_parity(values, firsts).T):
                    out[f"m{k}"] = np.ascontiguousarray(column)
                filled = sizes > 0
                edges = np.r_[0, np.cumsum(np.where(filled, bands, 0))].astype(np.int32)
                cols = [b.column("doc_id").slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(keys[filled].ravel().view(np.int64)))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(out[k].view(np.int64)) for k in longs)], names=["doc_id", "n_shingles", "bands", *longs])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, bands array<long>, " + ", ".join(f"{k} long" for k in longs))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int, samples: int) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and odd sketches allow for the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in WIDE)), side)
    return pairs.where(_similar(percent, samples)).select("a", "b")


def _differing(name: str, words: int) -> Column:
    counts = [F.bit_count(F.col(f"a_{name}{k}").bitwiseXOR(F.col(f"b_{name}{k}"))) for k in range(words)]
    return sum(counts[1:], counts[0])


def _similar(percent: int, samples: int) -> Column:
    """Whether sizes, set bitmaps and sample sketches of a pair allow for the threshold.

    J >= p / 100 means that the symmetric difference is at most (100 - p) / (100 + p) of both sizes' sum.
    """
    sizes = F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * percent
    sets = _differing("m", SET_WORDS) * (100 + percent) <= (F.col("a_n_shingles") + F.col("b_n_shingles")) * (100 - percent)
    return sizes & sets & (_differing("s", SKETCH_WORDS) <= odd_sketch_limit(percent / 100, samples))


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with 100 * |intersection| >= percent * |union| on full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in blocks(batch.column("a_text")):
                x, xf = shingle_sets(data, offs, n)
                ok = np.zeros(hi - lo, bool)
                for lo2, hi2, data2, offs2 in blocks(batch.column("b_text").slice(lo, hi - lo)):
                    y, yf = shingle_sets(data2, offs2, n)
                    for k in range(lo2, hi2):
                        p, q = x[xf[k] : xf[k + 1]], y[yf[k - lo2] : yf[k - lo2 + 1]]
                        both = np.concatenate([p, q])
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        ok[k] = len(p) > 0 and 100 * shared >= percent * (len(both) - shared)
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(lo, hi - lo).filter(pa.array(ok)) for c in ("a", "b")], names=["u", "v"])

    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    a, b = (texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"{s}_text")) for s in "ab")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, seed: int = 4) -> DataFrame:
    """Classes of near-duplicate documents (doc_id, text; more columns are ignored).

    Two documents are linked if their sets of n-word shingles (A-Z lower-cased) have a Jaccard
    similarity of `percent` or more. Returns a row per row: doc_id, n_shingles, component_id (the
    smallest doc_id reachable by links, itself included), kept (doc_id = component_id).

    A null text counts as empty; texts without words have no shingles, are linked with nothing and
    kept. doc_ids are to be unique: repeated rows each get their row, but where rows share a doc_id and
    differ in text, classes whose smallest doc_id is that one count as linked. A row without doc_id
    gets the component of texts with an equal set, else null, and is kept in the latter case only.
    An empty table gives no rows.
    """
    threshold = percent / 100
    bands, rows = banding(threshold)
    spark = docs.sparkSession
    ship(spark)
    sigs = cut(signatures(docs, n, bands, rows, seed), "signatures")
    rest = [F.first(c).alias(c) for c in (*WIDE, "bands")]
    classes = cut(sigs.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("node"), *rest).where("node IS NOT NULL"), "classes")

    keyed = classes.select("node", F.explode("bands").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, "key"), "shared")
    few = shared.where(F.col("n") <= SMALL).select("key", "node")
    pairs = few.withColumnRenamed("node", "a").join(few.withColumnRenamed("node", "b"), "key").where("a < b").select("a", "b")
    many = shared.where(F.col("n") > SMALL)
    central = many.groupBy("node").agg(F.sum("n").alias("weight"))
    many = cut(many.join(central, "node").select("key", "node", "weight"), "many")
    leads = many.groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("lead"))
    starred = many.join(leads, "key").where("lead <> node").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b"))
    pairs = _possible(pairs.union(starred).distinct(), classes, percent, bands * rows)
    links = cut(verified(pairs, docs, n, percent), "links")
    free_shuffles(spark)
    found = cut(components(links), "components")

    # What large buckets still hold apart: rows of components other than the bucket's largest.
    large = many.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parts = large.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    apart = large.join(largest.select("key", F.col("top.component").alias("top")), "key")
    apart = cut(apart.join(classes.select("node", *WIDE), "node"), "apart")
    if not apart.isEmpty():
        a = apart.where("component <> top").select("key", F.col("node").alias("a"), F.col("component").alias("a_component"), *(F.col(c).alias(f"a_{c}") for c in WIDE))
        b = apart.select("key", "top", F.col("node").alias("b"), F.col("component").alias("b_component"), *(F.col(c).alias(f"b_{c}") for c in WIDE))
        differ = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("top")) | (F.col("a") < F.col("b")))
        more = a.join(b, (a["key"] == b["key"]) & differ & _similar(percent, bands * rows)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = cut(more, "more")
        if not more.isEmpty():
            links = links.union(cut(verified(more, docs, n, percent), "links"))
            free_shuffles(spark)
            found = cut(components(links), "components")

    named = classes.select("d0", "d1", "node").join(found, "node", "left").select("d0", "d1", F.coalesce("component", "node").alias("component_id"))
    out = sigs.select("doc_id", "n_shingles", "d0", "d1").join(named, ["d0", "d1"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of all `documents`: 3-word shingles, a similarity of 0.85 or more; see near_duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)
