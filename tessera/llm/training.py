"""Labelled rows to fit a classifier on: a bounded, seeded sample of those outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_mod

#: Most labelled rows that a classifier is fitted on. With fewer, all are used.
SAMPLE = 20_000
FOLDS = 5


def held_out():
    """Whether a row is in the fold from which no label is learned; a row without doc_id isn't."""
    return F.coalesce(crc_mod("doc_id", FOLDS) == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, label: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label (0 or 1) of a sample of the labelled documents outside the held-out fold.

    The sample is the `sample` ids with the least hashes, so it is the same in every run, and small
    enough to be broadcast. Several labels of an id count as their greatest; null ones as none;
    of several texts of an id the least is taken, so the sample bounds the rows too.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out())
    own = own.groupBy("doc_id").agg(F.max(F.col(label).cast("double")).alias("__label"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("__label").alias("label"))
