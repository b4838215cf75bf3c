"""Operator 12, target-distribution importance resampling: documents drawn by how like a target their features are.

Two Arrow passes over the texts. In the first each partition counts its hashed features with
np.bincount into one vector, and treeReduce adds the vectors up; the second gathers a broadcast gain
for each feature and sums a document's with np.bincount weights. Features are hashed once per
distinct run of words of a block. Gumbel noise from a hash of doc_id turns the sums into a draw
without replacement: the highest sums of weight and noise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, cut, owner, table
from tessera.llm.terms import ALNUM, encoded
from tessera.operators.order import numbered
from tessera.runtime import ship

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
_BLOCK = 1 << 22


def features(data: np.ndarray, offs: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text, words of each text): a feature is a run of 1 to n words,
    joined by a space, and its bucket the CRC-32 of its bytes modulo `buckets`."""
    ids, words, firsts = encoded(data, offs, ALNUM)
    words, who = words.cast(pa.binary()).to_pylist(), owner(firsts)
    codes = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
    run, found, texts = ids, [codes[ids] % buckets], [who]
    for k in range(1, n):
        at = np.flatnonzero(who[:-k] == who[k:]) if len(who) > k else np.zeros(0, np.int64)
        pairs, of = np.unique(run[at] * len(words) + ids[at + k], return_inverse=True)
        codes = np.fromiter((zlib.crc32(b" " + words[p % len(words)], int(codes[p // len(words)])) for p in pairs.tolist()), np.int64, len(pairs))
        run = np.zeros(len(who), np.int64)
        run[at] = of
        found.append(codes[of] % buckets)
        texts.append(who[at])
    return np.concatenate(found), np.concatenate(texts), np.diff(firsts)


def bucket_counts(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column `text`, null: none) fall into each bucket."""
    ship(texts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, data, offs in blocks(b.column(0), _BLOCK):
                total += np.bincount(features(data, offs, n, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    vectors = texts.select("text").mapInArrow(run, "counts binary").rdd.map(lambda row: np.frombuffer(bytes(row[0]), np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of a bucket's smoothed share in the target to that in all texts, rounded down."""
    s, t, k = all_counts.astype(float), target_counts.astype(float), float(len(all_counts))
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + k)) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_words, n_features, weight, score, rank.

    weight is the sum of the gains of its features against the texts of `target`, score adds the noise
    of its doc_id. `percent` of the documents with at least `least_words` words are drawn, by score and
    then doc_id; they have a rank from 1, all others null. A null text has no features and a weight of 0,
    and an empty target or table has counts of 0. A null doc_id has the noise of an empty id and comes
    last among ties; rows that share an id share its noise, and among equal rows any may be drawn first.
    """
    spark = docs.sparkSession
    ship(spark)
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets)).astype(float))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text"), _BLOCK):
                found, of, n_words = features(data, offs, n, buckets)
                n_features = np.bincount(of, minlength=hi - lo)
                weight = np.bincount(of, weights=gain.value[found], minlength=hi - lo).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise).withColumn("__row", F.monotonically_increasing_id()), "importance")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    order = [(~enough).cast("int"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("__row")]
    placed = numbered(scored, "place", order)
    return placed.withColumn("rank", F.when(enough & (F.col("place") <= drawn), F.col("place"))).select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all rows of `documents`, drawn towards the texts of `benchmark`; see resample."""
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
wanted AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
used AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM lowered) GROUP BY ALL),
crc_table AS MATERIALIZED (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS codes FROM range(256) r(i)),
vocabulary AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM used UNION SELECT word FROM wanted)),
hashed AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i::INT + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc_table),
source_counts AS (SELECT bucket, sum(n) AS s FROM used JOIN hashed USING (word) GROUP BY bucket),
target_counts AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(s) FROM source_counts), 0)::DOUBLE AS all_s, coalesce((SELECT sum(t) FROM target_counts), 0)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000)) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain
  FROM source_counts FULL JOIN target_counts USING (bucket), totals),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM used JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM lowered LEFT JOIN weights USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)
"""
