"""Loops that the driver runs over whole tables: each round is one plan over all queries that are still open."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.plans import sandbox


def shrink_to_budget(prompts: DataFrame, styles: Sequence[str], budget: int) -> DataFrame:
    """query_id, style, prompt: the first of the columns `styles`, from the fullest on, within the budget of tokens; the last if none is."""
    chosen = F.lit(styles[-1])
    for s in reversed(styles[:-1]):
        chosen = F.when(T.text_unit_count(F.col(s)) <= budget, F.lit(s)).otherwise(chosen)
    text = F.lit(None).cast("string")
    for s in styles:
        text = F.when(F.col("style") == s, F.col(s)).otherwise(text)
    return prompts.withColumn("style", chosen).select("query_id", "style", text.alias("prompt"))


def retried(tasks: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], budget: int, folder: str | None = None) -> DataFrame:
    """Runs tasks (task_id, ...) until each is accepted or has used `budget` retries.

    attempt(open tasks, number) returns task_id, accepted, result. Returns those and attempts. Each
    attempt is written under `folder`, which executors share, so it runs once whatever follows; by
    default that is the session's checkpoint folder.
    """
    spark, done, open_ = tasks.sparkSession, [], tasks
    folder = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("retried needs a folder, or spark.checkpoint.dir")
    run = f"{folder.rstrip('/')}/retried-{uuid.uuid4().hex}"
    for number in range(1, budget + 2):
        attempt(open_, number).withColumn("attempts", F.lit(number)).write.parquet(f"{run}/{number}")
        tried = spark.read.parquet(f"{run}/{number}")
        refused = tried.where("NOT coalesce(accepted, false)").select("task_id")
        if number == budget + 1 or refused.isEmpty():
            done.append(tried)
            break
        done.append(tried.where("accepted"))
        open_ = tasks.join(refused, "task_id", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def computed(requests: list[tuple[str, str]], assets: Callable[[str], DataFrame | None]) -> dict[str, DataFrame | None]:
    """One guarded statement per query, as a plan: (query id, statement) over the asset of the same id; what is refused gives None."""
    out: dict[str, DataFrame | None] = {}
    for name, sql in requests:
        if name not in out:  # a query computes once
            sheet = assets(name)
            try:
                out[name] = None if sheet is None else sandbox.rendered(sandbox.select(sheet, sql))
            except (sandbox.SqlRejected, AnalysisException):
                out[name] = None
    return out


def results(requests: list[tuple[str, str]], assets: Callable[[str], DataFrame | None], seconds: float = sandbox.MOST_SECONDS) -> dict[str, tuple[sandbox.Computed | None, str | None]]:
    """One guarded statement per query: (query id, statement) over the asset of the same id. Gives (result, None), or (None, why there is none)."""
    out: dict[str, tuple[sandbox.Computed | None, str | None]] = {}
    for name, sql in requests:
        if name in out:
            continue  # a query computes once
        sheet = assets(name)
        try:
            out[name] = (None, "no such asset") if sheet is None else (sandbox.compute(sheet, sql, name, seconds), None)
        except (sandbox.SqlRejected, sandbox.SqlTimeout, AnalysisException) as error:
            out[name] = (None, f"{type(error).__name__}: {str(error).splitlines()[0]}")
    return out


def answered(prompts: dict[str, str], generate: Callable[[str], str], assets: Callable[[str], DataFrame | None]) -> dict[str, str]:
    """A model's answers; where one asks for a computation, it is run once and the model asked again with its result."""
    out = {}
    for query, prompt in prompts.items():
        said = generate(prompt)
        found = re.search(r"(?s)<compute_request>(.*?)</compute_request>", said)
        if found:
            try:
                request = json.loads(found[1])
                asset, sql = str(request["asset_id"]), str(request["sql"])
            except (ValueError, KeyError, TypeError):
                out[query] = said
                continue
            result, why = results([(asset, sql)], assets)[asset]
            block = result.markdown() if result else f"[TABLE_COMPUTE_RESULT:asset_id={asset}]\n{why}"
            said = generate(f"{prompt}\n\n{block}")
        out[query] = said
    return out
