"""The engine as one object: documents in, ranked evidence and answers out, over tables in one folder.

Tables are of the store (documents, sections), so each change is one commit. Texts are cut, tokenised and
embedded when they come in: sections hold their vectors, the index of terms what can be found. Every
method takes and returns DataFrames and works on all rows at once.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import answers, evaluation, fusion, search, sections
from tessera.operators.postings import Postings
from tessera.plans import interpreter, policy
from tessera.runtime import ship
from tessera.sources import files
from tessera.sources.store import Store, transaction


@dataclass(frozen=True)
class Config:
    """Settings of an engine. `embed` is a column function from texts to vectors; without one, retrieval goes by terms alone."""

    window_tokens: int = 480
    overlap_tokens: int = 64
    top_k: int = 10
    alpha: float = 0.65
    location: str = "local"
    chat: str | None = None
    embed: Callable | None = None


# The names of the assembly profiles.
PROFILES = {
    "local_full": Config(location="local", chat="local"),
    "local_retrieval_cloud_chat": Config(location="local", chat="cloud"),
    "cloud_full": Config(location="cloud", chat="cloud"),
    "test_minimal": Config(window_tokens=120, overlap_tokens=20, embed=lambda c: T.hash_embedding(c, 16)),
}
_NUMBERS = {"window_tokens": int, "overlap_tokens": int, "top_k": int, "alpha": float}


def configured(profile: str = "test_minimal", given: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None) -> Config:
    """What is given wins over the environment (TESSERA_WINDOW_TOKENS and so on), and this over the profile; null and empty values don't count."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile!r}; there are {', '.join(PROFILES)}")
    environment = os.environ if environment is None else environment
    found = {k: kind(v) for k, kind in _NUMBERS.items() if (v := environment.get(f"TESSERA_{k.upper()}"))}
    found |= {k: v for k, v in (given or {}).items() if v is not None}
    return replace(PROFILES[profile], **found)


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config = PROFILES["test_minimal"]):
        self.spark, self.config = spark, config
        self.documents = Store(spark, f"{root}/documents", ["doc_id"], "shard")
        self.sections = Store(spark, f"{root}/sections", ["section_id"], "shard")
        self.postings = Postings(spark, f"{root}/postings")  # of the sections that are shown
        ship(spark)

    # --- in ------------------------------------------------------------------------------------

    def _sections_of(self, documents: DataFrame) -> DataFrame:
        parts = sections.refine(documents, "doc_id", "text", self.config.window_tokens, self.config.overlap_tokens)
        return parts.where(F.trim("section_text") != "").select(
            F.concat_ws(":", F.col("doc_id").cast("string"), F.col("window_index").cast("string")).alias("section_id"), "doc_id", F.col("window_index").alias("order_index"),
            "window_count", "char_start", "char_end", "section_text", self._vector("section_text"), F.pmod("doc_id", F.lit(64)).alias("shard"),
        )

    def _vector(self, text: str) -> Column:
        found = self.config.embed(text).cast("array<double>") if self.config.embed else F.lit(None).cast("array<double>")
        return found.alias("vector")

    def _changed(self):
        return transaction(self.documents, self.sections, self.postings.log)

    def _show(self, doc_ids: DataFrame) -> None:
        """Puts the stored sections of documents into the index of terms."""
        own = self.sections.read().join(doc_ids, "doc_id", "left_semi")
        self.postings.put(own.select(F.col("section_id").alias("doc_id"), F.col("section_text").alias("text")))

    def _unlist(self, doc_ids: DataFrame) -> None:
        """Takes the sections of documents out of the index of terms."""
        stored = self.sections.read()
        if stored is not None:
            self.postings.remove(stored.join(doc_ids, "doc_id", "left_semi").select(F.col("section_id").alias("doc_id")))

    def ingest(self, documents: DataFrame) -> dict[str, int]:
        """Takes documents in (location, title, text, source_type); returns how many were processed, new, unchanged and empty.

        A document's id follows from its location and its text, so what comes again changes nothing,
        and a new text at a known location is a new version, which becomes the active one. Of several
        rows with one location the last by text counts. Empty texts aren't taken in.
        """
        rows = documents.select("location", F.coalesce("title", "location").alias("title"), T.text_of("text").alias("text"), "source_type")
        n = rows.count()
        rows = rows.where(F.trim("text") != "").groupBy("location").agg(F.max_by(F.struct("title", "text", "source_type"), "text").alias("r")).select("location", "r.*")
        digest = F.sha2(F.col("text").cast("binary"), 256)
        rows = rows.withColumn("content_hash", digest).withColumn("doc_id", F.abs(F.xxhash64("location", "content_hash")) % (1 << 52))
        usable = documents.where(F.trim(T.text_of("text")) != "").count()
        old = self.documents.read()
        known = None if old is None else old.where("is_active").select("doc_id")
        fresh = rows if known is None else rows.join(known, "doc_id", "left_anti")
        new = fresh.count()
        if new:
            group = F.abs(F.xxhash64("location")) % (1 << 52)
            shard = F.pmod("doc_id", F.lit(64))
            added = fresh.select("*", group.alias("version_group_id"), F.lit(True).alias("is_active"), F.lit(True).alias("index_ready"), F.lit("published").alias("status"), shard.alias("shard"))
            changed, replaced = added, None
            if old is not None:
                replaced = old.where("is_active").join(added.select("version_group_id").distinct(), "version_group_id", "left_semi")
                changed = added.unionByName(replaced.withColumn("is_active", F.lit(False)).withColumn("index_ready", F.lit(False)))
            with self._changed():
                self.sections.replace_documents(self._sections_of(added))
                if replaced is not None:
                    self._unlist(replaced.select("doc_id"))
                self._show(added.select("doc_id"))
                self.documents.upsert(changed)  # seen last, when the sections are there
        return {"processed": n, "new": new, "unchanged": rows.count() - new, "empty": n - usable}

    def ingest_folder(self, folder: str, owner: str = "", recursive: bool = True) -> dict[str, int]:
        """Takes in the plain text and markdown files of a folder; other types need a parser, whose result `ingest` takes."""
        found = files.discover(self.spark, folder, owner, recursive).where(F.col("source_type").isin("plain_text", "markdown")).select("location", "title", "source_type")
        content = self.spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder).select(F.col("path").alias("location"), F.decode("content", "utf-8").alias("text"))
        joined = found.join(content, "location")
        return self.ingest(joined.select("location", "title", files.plain_text(F.col("text"), F.col("title")).alias("text"), "source_type"))

    # --- changes -------------------------------------------------------------------------------

    def _hide(self, doc_ids: list[int]) -> int:
        return self.documents.update(F.col("doc_id").isin(*doc_ids), {"is_active": F.lit(False), "index_ready": F.lit(False)}) if doc_ids else 0

    def delete(self, doc_ids: list[int]) -> int:
        """Hides documents and removes their sections; returns how many documents there were."""
        if not doc_ids or self.documents.read() is None:
            return 0
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id long")
        with self._changed():
            n = self._hide(doc_ids)
            self._unlist(gone)
            self.sections.delete(gone)
        return n

    def rebuild(self, doc_ids: list[int]) -> int:
        """Cuts documents into sections again, from what is stored of them, and shows them; returns how many there were."""
        stored = self.documents.read()
        own = stored.where(F.col("doc_id").isin(*doc_ids)) if stored is not None and doc_ids else None
        n = own.count() if own is not None else 0
        if n:
            with self._changed():
                self.sections.replace_documents(self._sections_of(own))
                self._show(own.select("doc_id"))
                self.documents.update(F.col("doc_id").isin(*doc_ids), {"is_active": F.lit(True), "index_ready": F.lit(True)})
        return n

    # --- out -----------------------------------------------------------------------------------

    def visible_sections(self) -> DataFrame:
        docs, parts = self.documents.read(), self.sections.read()
        if docs is None or parts is None:
            return self.spark.createDataFrame([], "section_id string, doc_id long, order_index int, section_text string, vector array<double>, title string, location string, source_type string")
        shown = docs.where(policy.visible(F.col("is_active"), F.col("index_ready"), F.col("status"))).select("doc_id", "title", "location", "source_type")
        vector = F.col("vector") if "vector" in parts.columns else self._vector("section_text")
        return parts.select("section_id", "doc_id", "order_index", "section_text", vector.alias("vector")).join(shown, "doc_id")

    def _retrievers(self, parts: DataFrame, narrowed: bool) -> dict[str, interpreter.Retriever]:
        """What serves the branches of a plan here, over the sections `parts`."""
        ids = parts.select(F.col("section_id").alias("doc_id")) if narrowed else None
        cols = ["query_id", "item_id", "score", "rank"]
        out = {"section": lambda q, n: self.postings.search(q, n, ids).withColumnRenamed("doc_id", "item_id").select(*cols)}
        if self.config.embed:
            items = parts.select(F.col("section_id").alias("item_id"), "vector")
            out["vector"] = lambda q, n: search.knn(items, q.select("query_id", self._vector("text")), n).select(*cols)
        return out

    def retrieve(self, queries: DataFrame, k: int | None = None, where: Column | None = None) -> DataFrame:
        """query_id, section_id, doc_id, score, rank, branches, section_text: the k best sections of each query (query_id, text).

        `where` is a condition on doc_id, title, location, source_type, section_id or order_index; what
        doesn't meet it isn't searched. Queries may have plans (paths, fallback, sparse_text, as `interpreter.run_plans`
        takes them); without, all branches run. Neither stored texts nor their vectors are made anew.
        """
        k = k or self.config.top_k
        parts = self.visible_sections()
        if where is not None:
            parts = parts.where(where)
        narrowed = where is not None or self.postings.statistics()[0] != parts.count()
        retrievers = self._retrievers(parts, narrowed)
        if "paths" not in queries.columns:
            variants = {"section": "sparse", "vector": "dense"}
            every = F.array(*(F.struct(F.lit(b).alias("branch"), F.lit(2 * k).alias("limit"), F.lit(variants[b]).alias("variant")) for b in retrievers))
            queries = queries.withColumn("paths", every)
        hits = interpreter.run_plans(queries, retrievers, interpreter.too_few(1))
        fused = fusion.reciprocal_rank(hits, fusion.branch_weights(hits, self.config.alpha)).where(F.col("unified_rank") <= k)
        named = fused.select("query_id", F.col("item_id").alias("section_id"), F.col("fused_score").alias("score"), F.col("unified_rank").alias("rank"), F.array_sort(F.map_keys("branch_scores")).alias("branches"))
        return named.join(parts, "section_id").select("query_id", "section_id", "doc_id", "title", "score", "rank", "branches", "section_text")

    def diagnostics(self, retrieved: DataFrame) -> DataFrame:
        """Per query: sections, documents, hits by branch, best score."""
        return retrieved.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("sections"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.array_contains("branches", "section")).alias("lexical"),
            F.count_if(F.array_contains("branches", "vector")).alias("dense"), F.max("score").alias("best_score"),
        )

    def answer(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """query_id, answer, insufficient, citations (array of section ids): the sentence that answers each query, and what supports it."""
        evidence = self.retrieve(queries, k).select(
            "query_id", F.col("rank").alias("place"), F.col("section_id").alias("evidence_id"), F.col("section_text").alias("text"), F.col("title").alias("anchor"), F.lit(None).cast("array<string>").alias("path"),
            "score", F.lit("section").alias("record_type"),
        )
        none = F.array().cast("array<string>")
        asked = queries.select("query_id", F.col("text").alias("query"), none.alias("focus"), F.lit(False).alias("needs_structure"), none.alias("targets"))
        short = answers.insufficient(asked, evidence)
        best = answers.grounded_candidates(asked, evidence)
        cited = answers.supporting(best, evidence).groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "evidence_id"))), lambda x: x["evidence_id"]).alias("citations"))
        out = best.join(short, "query_id").join(cited, "query_id", "left")
        text = F.when(F.col("insufficient"), answers.INSUFFICIENT).otherwise(F.col("answer"))
        return out.select("query_id", text.alias("answer"), "insufficient", F.when(F.col("insufficient"), none).otherwise(F.coalesce("citations", none)).alias("citations"))

    def evaluate(self, queries: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
        """Ranking metrics of each query (query_id, text) by judgments (query_id, doc_id, relevance) of documents."""
        k = k or self.config.top_k
        found = self.retrieve(queries, 4 * k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
        from pyspark.sql.window import Window

        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "doc_id")))
        return evaluation.ranking_metrics(ranked.select("query_id", "doc_id", "rank"), qrels, k)

    def stats(self) -> dict[str, int]:
        docs, parts = self.documents.read(), self.sections.read()
        return {"documents": docs.count() if docs is not None else 0, "active": docs.where("is_active").count() if docs is not None else 0, "sections": parts.count() if parts is not None else 0}
