"""Column helpers of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns behind a Generate node, so that no expression is copied into the lambdas that use it."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_array(values) -> str:
    return "array(" + ", ".join(quoted(v) if isinstance(v, str) else str(v) for v in values) + ")"


def sql_case(on: str, table: dict, default: str, kind: str = "") -> str:
    """CASE over a table, one branch a value."""
    by: dict = {}
    for k, v in table.items():
        by.setdefault(v, []).append(k)
    show = lambda v: f"{v!r}{kind}" if not isinstance(v, str) else quoted(v)
    return "CASE " + " ".join(f"WHEN {on} IN ({', '.join(quoted(k) for k in ks)}) THEN {show(v)}" for v, ks in by.items()) + f" ELSE {default} END"
