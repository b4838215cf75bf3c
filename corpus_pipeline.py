"""From raw documents to a training mix, in five stages. Counted as part of tessera.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; all but the last return the
columns of documents, and no others that a table may have besides. Between stages the rows are written
as Parquet into the shared folder. Rows are judged one by one: a doc_id may be missing or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, table
from tessera.llm.decontamination import without_contaminated
from tessera.llm.mixing import mix_sources
from tessera.llm.near_dups import near_duplicates
from tessera.llm.quality_classifier import score_quality
from tessera.llm.repeats import remove_repeats
from tessera.runtime import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject; it is fitted on labelled rows of docs."""
    scored = score_quality(docs, table(spark, sf_dir, "labels"), COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Rows have a key of their own here, so repeated rows, rows that share a doc_id and rows without
    one are told apart. The row with the smallest doc_id stays, one without a doc_id if no other is there.
    Texts without words are in no group and stay.
    """
    ship(spark)
    rows = cut(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), n=5, percent=80)
    groups = rows.select("__row", "doc_id").join(found.select(F.col("doc_id").alias("__row"), "component_id"), "__row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).getField("__row").alias("__row")
    return rows.join(groups.groupBy("component_id").agg(first), "__row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 bytes or more that an earlier document has; n_chars follows.

    A document of which only white space is left goes. Rows that share a doc_id don't cut each other,
    rows without one count as the last.
    """
    ship(spark)
    out = remove_repeats(docs.select(*COLUMNS))
    emptied = (F.col("removed_bytes") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    n_chars = F.when(F.col("removed_bytes") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", n_chars).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a copy of a benchmark item, each judged by its own text."""
    return without_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix),
]

#: No SQL expresses the fitted classifier; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
