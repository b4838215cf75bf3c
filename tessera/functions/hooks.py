"""Where models come in: a factory makes the model once per worker, and batches go through it.

A model is any object with the method named below; the factory must be importable on executors, or
picklable. Results must be as many as the inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import structured
from tessera.runtime import ship


class WrongCount(ValueError):
    pass


def _same_count(found: Sequence, wanted: int) -> list:
    found = list(found)
    if len(found) != wanted:
        raise WrongCount(f"{len(found)} results for {wanted} inputs")
    return found


def _shipped(function: Callable[..., Column]) -> Callable[..., Column]:
    """The column function, which sends the package to executors when it is first used."""

    def apply(*columns: Column | str) -> Column:
        if (spark := SparkSession.getActiveSession()) is not None:
            ship(spark)
        return function(*columns)

    return apply


def embedder(factory: Callable[[], Any]) -> Callable[[Column], Column]:
    """A column function: texts to vectors, by model.embed(texts)."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series([list(map(float, v)) for v in _same_count(model.embed([t or "" for t in texts]), len(texts))])

    return _shipped(embed)


def generator(factory: Callable[[], Any]) -> Callable[[Column], Column]:
    """A column function: prompts to texts; null where the model failed, see `told`."""
    generate = told(factory)
    return lambda prompt: generate(prompt)["text"]


def told(factory: Callable[[], Any]) -> Callable[[Column], Column]:
    """A column function: prompts to structs of text and error, by model.generate_text(prompt).

    A model's failure is that row's error, and its text null, so the caller can fall back; one that
    can't be made fails the job.
    """

    @F.pandas_udf("text string, error string")
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()

        def one(prompt):
            try:
                return model.generate_text(prompt or ""), None
            except Exception as error:  # whatever a model raises is told with the row
                return None, f"{type(error).__name__}: {error}"

        for prompts in batches:
            yield pd.DataFrame([one(p) for p in prompts], columns=["text", "error"])

    return _shipped(generate)


def structured_generator(factory: Callable[[], Any], schema: str, required: tuple[str, ...] = ()) -> Callable[[Column], Column]:
    """A column function: prompts to structs of `schema`, read from what the model says; null where that isn't one JSON object with the required fields."""
    generate = generator(factory)
    return lambda prompt: structured.typed(generate(prompt), schema, required)


def described(factory: Callable[[], Any]) -> Callable[[Column], Column]:
    """A column function: images (binary) to texts, by model.extract(bytes) -> text, as OCR and vision models have it; null for no image."""

    @F.pandas_udf("string")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for images in batches:
            yield images.map(lambda b: None if b is None else str(model.extract(bytes(b))))

    return _shipped(describe)


def rerank(candidates: DataFrame, factory: Callable[[], Any], pool: int = 50, batch: int = 16) -> DataFrame:
    """Adds rerank_score to the best `pool` candidates (query_id, query_text, candidate_id, score, text) of each query.

    model.rerank(query, documents) gives a score for each document; candidates beyond the pool have none.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for queries, texts in batches:
            out = pd.Series([0.0] * len(texts))
            for query, own in texts.groupby(queries, sort=False):
                for at in range(0, len(own), batch):
                    part = own.iloc[at : at + batch]
                    out.loc[part.index] = _same_count(model.rerank(query, [t or "" for t in part]), len(part))
            yield out.astype(float)

    ship(candidates.sparkSession)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")
    placed = candidates.withColumn("__place", F.row_number().over(order))
    inside = placed.where(F.col("__place") <= pool).withColumn("rerank_score", score("query_text", "text"))
    return inside.unionByName(placed.where(F.col("__place") > pool).withColumn("rerank_score", F.lit(None).cast("double"))).drop("__place")


def first_of(*columns: Column) -> Column:
    """The first provider's result that isn't null, in order of preference."""
    return F.coalesce(*columns)


def picked(capability: str, explicit: str | None, profile: dict[str, str], config: dict[str, str], environment: dict[str, str], default: str | None = None) -> str | None:
    """The provider of a capability: what is asked for, else by profile, configuration, environment (PROVIDER_<CAPABILITY>), else the default."""
    return explicit or profile.get(capability) or config.get(capability) or environment.get(f"PROVIDER_{capability.upper()}") or default


def provider_order(local: Sequence[str], cloud: Sequence[str], residency: str) -> list[str]:
    """Providers in order for a residency: cloud_allowed, local_preferred or local_required; each once."""
    if residency == "local_required":
        return list(dict.fromkeys(local))
    first, second = (local, cloud) if residency == "local_preferred" else (cloud, local)
    return list(dict.fromkeys([*first, *second]))


def merged_config(*layers: dict[str, Any]) -> dict[str, Any]:
    """Settings by precedence: the first layer that has a value for a key, and not null, wins."""
    out: dict[str, Any] = {}
    for layer in reversed(layers):
        out |= {k: v for k, v in layer.items() if v is not None}
    return out
