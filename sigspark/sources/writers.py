"""Writing rules: text, JSON lines, JSON arrays and envelopes, Parquet, and their JSON Schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.printer import rule_text

VERSION = "1.0.0"


def write_text(rules: DataFrame, path: str, style: str = "standard", mode: str = "error") -> None:
    rules.select(rule_text(style).alias("value")).write.mode(mode).text(path)


def write_json(rules: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; bytes as base64, nulls left out."""
    rules.write.mode(mode).json(path)


def write_parquet(rules: DataFrame, path: str, partition_by: tuple[str, ...] = ("dialect",), mode: str = "error") -> None:
    rules.write.mode(mode).partitionBy(*partition_by).parquet(path)


def to_json(rules: DataFrame) -> Column:
    """The rule as lossless JSON."""
    return F.to_json(F.struct(*[F.col(c) for c in rules.columns]))


def envelope(rules: DataFrame) -> Column:
    """ast_version, timestamp, count and data of a single rule."""
    return F.to_json(F.struct(F.lit(VERSION).alias("ast_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(1).alias("count"), F.struct(*[F.col(c) for c in rules.columns]).alias("data")))


def envelopes(rules: DataFrame, order: str, size: int = 1000) -> DataFrame:
    """(batch, json): the rules in envelopes of at most ``size``, by runs of order // size; no task holds more than one run."""
    one = F.struct(*[F.col(c) for c in rules.columns])
    runs = rules.groupBy(F.expr(f"{order} div {size}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.to_json(one).alias("j")))).alias("l"))
    listed = F.concat(F.lit('{"rules":['), F.array_join("l.j", ","), F.lit("]}"))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    head = F.concat(F.lit(f'{{"ast_version":"{VERSION}","timestamp":"'), stamp, F.lit('","count":'), F.size("l").cast("string"), F.lit(',"data":'))
    return runs.select("batch", F.concat(head, listed, F.lit("}")).alias("json"))


def write_json_array(rules: DataFrame, path: str) -> int:
    """One JSON array in a local file, streamed through the driver a partition at a time; returns the count."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in rules.select(to_json(rules).alias("j")).toLocalIterator():
            f.write((",\n" if n else "\n") + row.j)
            n += 1
        f.write("\n]\n")
    return n


_JSON = {"string": "string", "integer": "integer", "long": "integer", "double": "number", "boolean": "boolean", "binary": "string"}


def json_schema(kind: T.DataType) -> dict:
    """JSON Schema (2020-12) of a Spark type."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "additionalProperties": False}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": _JSON.get(kind.typeName(), "string")}


def schema_text(rules: DataFrame) -> str:
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Rule", **json_schema(rules.schema)}, indent=2)
