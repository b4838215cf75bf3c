"""Command line of the engine and of the registered queries."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import registry
from tessera.engine import PROFILES, Engine, configured
from tessera.sources import files


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *arguments: str, engine: bool = True) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        if engine:
            p.add_argument("root", help="folder of the engine's tables")
            p.add_argument("--profile", default="test_minimal", choices=sorted(PROFILES))
        for a in arguments:
            p.add_argument(a)
        return p

    command("list", "names the registered queries", engine=False)
    command("run", "runs a registered query over the tables of a folder", "name", "folder", engine=False).add_argument("--out", help="writes the result there as Parquet")
    command("explain", "shows the plan of a registered query", "name", "folder", engine=False)
    command("profiles", "names the profiles and their settings", engine=False)
    command("ingest", "takes in a folder of files, or a JSON lines file of documents", "source").add_argument("--flat", action="store_true", help="without sub-folders")
    p = command("query", "answers a question", "text")
    p.add_argument("--evidence", action="store_true", help="shows the evidence instead of the answer")
    command("delete", "removes documents").add_argument("doc_ids", nargs="+", type=int)
    command("rebuild", "cuts documents into sections again").add_argument("doc_ids", nargs="+", type=int)
    command("stats", "counts what there is")
    command("export", "writes all sections as JSON lines", "out")
    p = command("benchmark-ingest", "takes in the prepared documents of a benchmark (JSON lines)", "documents")
    p = command("benchmark-evaluate", "ranking metrics over queries and judgments (JSON lines; judgments may be TSV)", "queries", "qrels")
    p.add_argument("--top-k", type=int)
    p.add_argument("--history", help="appends the means there, as JSON lines")
    p = command("benchmark-subset", "writes a seeded subset of a prepared benchmark", "documents", "queries", "qrels", "out", engine=False)
    p.add_argument("--queries-wanted", type=int, default=200)
    p.add_argument("--documents-wanted", type=int, default=5000)
    return out


def _documents(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("doc_id string, title string, text string, source_type string, metadata map<string,string>").json(path)
    ready = files.with_defaults(rows).join(rows.select("doc_id", "source_type"), "doc_id")
    return ready.select(F.col("doc_id").alias("location"), "title", "text", F.coalesce("source_type", F.lit("plain_text")).alias("source_type"))


def _qrels(spark: SparkSession, path: str) -> DataFrame:
    return files.read_qrels(spark, path) if path.endswith(".tsv") else files.read_qrels_jsonl(spark, path)


def _queries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("query_id string, query_text string, text string").json(path)
    return rows.select("query_id", F.coalesce("query_text", "text").alias("text"))


def _say(value: object) -> None:
    print(json.dumps(value, ensure_ascii=False, default=str))


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    if args.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    if args.command == "profiles":
        for name, c in sorted(PROFILES.items()):
            _say({"profile": name, "location": c.location, "chat": c.chat, "window_tokens": c.window_tokens, "overlap_tokens": c.overlap_tokens})
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command in ("run", "explain"):
        plans = registry.queries()
        if args.name not in plans:
            print(f"no query {args.name!r}", file=sys.stderr)
            return 2
        result = plans[args.name](spark, args.folder)
        if args.command == "explain":
            result.explain("formatted")
        elif args.out:
            result.write.parquet(args.out)
        else:
            result.show(20, truncate=80)
        return 0
    if args.command == "benchmark-subset":
        documents = spark.read.json(args.documents)
        queries, docs = files.mini_subset(documents, spark.read.json(args.queries), _qrels(spark, args.qrels), args.queries_wanted, args.documents_wanted)
        queries.write.json(f"{args.out}/queries")
        docs.write.json(f"{args.out}/documents")
        return 0
    engine = Engine(spark, args.root, configured(args.profile))
    if args.command == "ingest":
        _say(engine.ingest(_documents(spark, args.source)) if args.source.endswith((".jsonl", ".json")) else engine.ingest_folder(args.source, recursive=not args.flat))
    elif args.command == "benchmark-ingest":
        _say(engine.ingest(_documents(spark, args.documents)))
    elif args.command == "query":
        asked = spark.createDataFrame([(0, args.text)], "query_id long, text string")
        for r in (engine.retrieve(asked).orderBy("rank") if args.evidence else engine.answer(asked)).collect():
            _say(r.asDict())
    elif args.command in ("delete", "rebuild"):
        _say({"documents": getattr(engine, args.command)(args.doc_ids)})
    elif args.command == "stats":
        _say(engine.stats())
    elif args.command == "export":
        parts = engine.visible_sections()
        parts.orderBy("doc_id", "order_index").write.json(args.out)
    elif args.command == "benchmark-evaluate":
        documents = engine.documents.read().select("doc_id", "location")
        qrels = _qrels(spark, args.qrels).withColumnRenamed("doc_id", "location").join(documents, "location").select("query_id", "doc_id", "relevance")
        means = engine.evaluate(_queries(spark, args.queries), qrels, args.top_k).agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")))
        if args.history:
            means.coalesce(1).write.mode("append").json(args.history)
        _say(means.first().asDict())
    return 0


if __name__ == "__main__":
    sys.exit(main())
