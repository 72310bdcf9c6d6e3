"""Composable processors over rule DataFrames, batch or streaming: ``Filter(...) | Validate() | Transform(...)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIAGNOSTIC = "array<struct<level:string,code:string,message:string>>"


class Processor:
    """A step from DataFrame to DataFrame."""

    def apply(self, rules: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __or__(self, other: Processor) -> Chained:
        return Chained([self, other])

    def __call__(self, rules: DataFrame) -> DataFrame:
        return self.apply(rules)


class Chained(Processor):
    def __init__(self, steps: list[Processor]) -> None:
        self.steps = [y for x in steps for y in (x.steps if isinstance(x, Chained) else [x])]

    def apply(self, rules: DataFrame) -> DataFrame:
        for step in self.steps:
            rules = step.apply(rules)
        return rules


class Filter(Processor):
    """Keeps rules for which the condition is true; null counts as false."""

    def __init__(self, condition: Column | str) -> None:
        self.condition = F.expr(condition) if isinstance(condition, str) else condition

    def apply(self, rules: DataFrame) -> DataFrame:
        return rules.where(F.coalesce(self.condition, F.lit(False)))


class Transform(Processor):
    """Replaces or adds columns, or applies a function of the whole DataFrame."""

    def __init__(self, function: Callable[[DataFrame], DataFrame] | None = None, **columns: Column | str) -> None:
        self.function, self.columns = function, {k: F.expr(v) if isinstance(v, str) else v for k, v in columns.items()}

    def apply(self, rules: DataFrame) -> DataFrame:
        rules = self.function(rules) if self.function else rules
        return rules.withColumns(self.columns) if self.columns else rules


def validation() -> Column:
    """missing_sid and missing_msg warnings, then the rule's own diagnostics."""
    one = lambda code, text: F.expr(f"array(named_struct('level', 'warning', 'code', '{code}', 'message', '{text}'))")
    none = F.array().cast(DIAGNOSTIC)
    sid = F.when(F.col("sid").isNull(), one("missing_sid", "rule has no sid")).otherwise(none)
    msg = F.when(F.col("msg").isNull(), one("missing_msg", "rule has no msg")).otherwise(none)
    return F.concat(sid, msg, F.col("diagnostics"))


class Validate(Processor):
    """Adds diagnostics; ``strict`` drops rules with an error. checks: name -> condition that a rule should meet."""

    def __init__(self, strict: bool = False, checks: dict[str, str] | None = None, level: str = "warning") -> None:
        self.strict, self.checks, self.level = strict, checks or {}, level

    def apply(self, rules: DataFrame) -> DataFrame:
        found = validation()
        for code, condition in self.checks.items():
            extra = F.array(F.struct(F.lit(self.level).alias("level"), F.lit(code).alias("code"), F.lit(condition).alias("message")))
            found = F.concat(found, F.when(F.coalesce(F.expr(condition), F.lit(False)), F.array().cast(DIAGNOSTIC)).otherwise(extra))
        rules = rules.withColumn("diagnostics", found)
        return rules.where("not exists(diagnostics, d -> d.level = 'error')") if self.strict else rules


class Aggregate(Processor):
    """Aggregates by keys; on a stream it runs in complete or update mode."""

    def __init__(self, *keys: str, **values: Column) -> None:
        self.keys, self.values = keys, values or {"rules": F.count(F.lit(1))}

    def apply(self, rules: DataFrame) -> DataFrame:
        return rules.groupBy(*self.keys).agg(*[v.alias(k) for k, v in self.values.items()])


def missing_lua_scripts(rules: DataFrame, scripts: DataFrame) -> DataFrame:
    """(sid, script_name) of lua options whose script is not among scripts (one column)."""
    used = rules.select("sid", F.explode(F.expr("filter(options, o -> o.node_type in ('LuaOption', 'LuajitOption')).script_name")).alias("script_name"))
    return used.join(scripts.select(F.col(scripts.columns[0]).alias("script_name")).distinct(), "script_name", "left_anti")
