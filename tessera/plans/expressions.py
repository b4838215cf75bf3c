"""The filter-expression language of index searches, as Spark columns.

Grammar: `and`, `or`, parentheses, `field in [a, b]`, and `== <= >= < > !=` between a field and a
literal. Literals are numbers, quoted strings, true and false. Fields must be on a list.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(-?\d+(?:\.\d+)?)|(==|!=|<=|>=|<|>|\(|\)|\[|\]|,)|([A-Za-z_]\w*))")


class ExpressionError(ValueError):
    pass


def parse(text: str, fields: Iterable[str]) -> Column:
    """The predicate as a column; an empty text accepts all rows."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r}")
        at = m.end()
        if m[1]:
            tokens.append(("value", re.sub(r"\\(.)", r"\1", m[1][1:-1])))
        elif m[2]:
            tokens.append(("value", float(m[2]) if "." in m[2] else int(m[2])))
        else:
            tokens.append(("op", m[3]) if m[3] else ("word", m[4]))
    if not tokens:
        return F.lit(True)
    known, position = set(fields), 0

    def peek() -> tuple:
        return tokens[position] if position < len(tokens) else ("end", None)

    def take(*want) -> tuple:
        nonlocal position
        found = peek()
        if want and found[1] not in want:
            raise ExpressionError(f"{found[1]!r} instead of {' or '.join(map(str, want))}")
        position += 1
        return found

    def value():
        kind, v = take()
        if kind == "word" and v.lower() in ("true", "false"):
            return v.lower() == "true"
        if kind != "value":
            raise ExpressionError(f"{v!r} is no literal")
        return v

    def atom() -> Column:
        if peek() == ("op", "("):
            take()
            out = either()
            take(")")
            return out
        kind, name = take()
        if kind != "word" or name not in known:
            raise ExpressionError(f"no field {name!r}")
        op = take("in", "==", "!=", "<=", ">=", "<", ">")[1]
        c = F.col(name)
        if op == "in":
            take("[")
            values = []
            while peek() != ("op", "]"):
                values.append(value())
                if peek() != ("op", "]"):
                    take(",")
            take("]")
            return c.isin(values) if values else F.lit(False)
        v = value()
        return {"==": c == v, "!=": c != v, "<=": c <= v, ">=": c >= v, "<": c < v, ">": c > v}[op]

    def both() -> Column:
        out = atom()
        while peek() == ("word", "and"):
            take()
            out = out & atom()
        return out

    def either() -> Column:
        out = both()
        while peek() == ("word", "or"):
            take()
            out = out | both()
        return out

    out = either()
    if position != len(tokens):
        raise ExpressionError(f"unexpected {peek()[1]!r}")
    return out
