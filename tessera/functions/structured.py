"""Structured text within a model's output, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_object(text: Column) -> Column:
    """What lies between the first { and the last } of a text, if all of it is one JSON object; else null.

    It is read as the only element of an array, so anything that follows the object breaks it.
    """
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0)
    whole = F.from_json(F.concat(F.lit("["), found, F.lit("]")), "array<string>")
    return F.when((found != "") & (F.size(whole) == 1), found)


def typed(text: Column, schema: str, required: tuple[str, ...] = ()) -> Column:
    """The object of a text as a struct of `schema`; null if there is none or a required field is null."""
    value = F.from_json(json_object(text), schema)
    ok = value.isNotNull()
    for name in required:
        ok = ok & value[name].isNotNull()
    return F.when(ok, value)
