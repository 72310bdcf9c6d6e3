"""Rule rewriting: option order, fast pattern, redundancy; to a fixed point of at most three rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import let, quoted, sql_case
from ..functions.cost import position_penalty, rule_cost

ROUNDS = 3
#: strategy -> its count in the statistics
STRATEGIES = {"OptionReorder": "reorders", "FastPattern": "fast_patterns", "RedundancyRemoval": "removals"}
_ORDER = sql_case("o.node_type", S.REORDER, "50")


def reorder(options: str) -> str:
    """SQL for the options in stable order of the priority table."""
    return f"transform(array_sort(transform({options}, (o, i) -> struct({_ORDER} as p, i as i))), s -> {options}[s.i])"


def fast_pattern(options: str) -> str:
    """SQL for the options with fast_pattern added to the best content of a rule with two contents and none yet."""
    none = f"not exists({options}, o -> o.node_type = 'FastPatternOption' or exists(coalesce(o.modifiers, array()), m -> m.name = 'fast_pattern'))"
    factor = "CASE WHEN m.name = 'nocase' THEN 0.7D WHEN m.name in ('offset', 'depth', 'distance', 'within') THEN 0.9D ELSE 1.0D END"
    score = (
        "length(o.pattern) * 10.0D * if(length(o.pattern) < 4, 0.5D, 1.0D) * if(contains(hex(o.pattern), '7C') and instr(cast(o.pattern as string), '|') > 0, 0.8D, 1.0D) "
        f"* aggregate(coalesce(o.modifiers, array()), 1.0D, (p, m) -> p * {factor})"
    )
    ranked = f"array_max(filter(transform({options}, (o, i) -> if(o.node_type = 'ContentOption', struct({score} as s, -i as i), null)), x -> x is not null))"
    added = "struct('fast_pattern' as name, cast(null as int) as int_value, cast(null as string) as str_value)"
    rows = f"transform(array({ranked}), b -> transform({options}, (o, i) -> if(b is not null and b.s > 0 and i = -b.i, {_with_modifier(added)}, o)))[0]"
    return f"if(size(filter({options}, o -> o.node_type = 'ContentOption')) >= 2 and {none}, {rows}, {options})"


_FIELDS: list[str] = []


def _with_modifier(added: str) -> str:
    fields = ", ".join(f"{quoted(f)}, " + (f"concat(o.modifiers, array({added}))" if f == "modifiers" else f"o.`{f}`") for f in _FIELDS)
    return f"named_struct({fields})"


def drop_redundant(options: str) -> str:
    """SQL for the options without later ones equal to an earlier one, of the types that may go."""
    keys = f"transform({options}, o -> concat(o.node_type, '|', o.raw, '|', coalesce(array_join(o.modifiers.name, ','), '')))"
    never = ", ".join(quoted(t) for t in S.NEVER_REDUNDANT)
    return f"transform(array({keys}), k -> filter({options}, (o, i) -> o.node_type in ({never}) or array_position(k, k[i]) = i + 1))[0]"


def optimize(rules: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Adds optimized (options), cost_before, cost_after, improvement (%), strategies and modified.

    Rounds are unrolled; each step is bound once, so the plan grows in proportion to the rounds.
    """
    _FIELDS[:] = [f.name for f in rules.schema["options"].dataType.elementType.fields]
    rows = let(rules, optimized=F.col("options"), strategies=F.array().cast("array<string>"), _live=F.lit(True))
    for _ in range(rounds):
        rows = rows.withColumn("_was", F.size("strategies"))
        for name, step in (("OptionReorder", reorder), ("FastPattern", fast_pattern), ("RedundancyRemoval", drop_redundant)):
            rows = let(rows, _next=F.when(F.col("_live"), F.expr(step("optimized"))).otherwise(F.col("optimized")))
            named = F.when(F.col("_live") & (F.col("_next") != F.col("optimized")), F.array_append("strategies", F.lit(name))).otherwise(F.col("strategies"))
            rows = rows.withColumn("strategies", named).drop("optimized").withColumnRenamed("_next", "optimized")
        rows = let(rows.drop("_live"), _live=F.size("strategies") > F.col("_was")).drop("_was")  # a round without a change is the last
    rows = rows.drop("_live")
    rows = let(rows, cost_before=rule_cost("options"), cost_after=rule_cost("optimized"), penalty_before=position_penalty("options"), penalty_after=position_penalty("optimized"))
    gain = F.when(F.col("cost_before") > 0, F.round((F.col("cost_before") - F.col("cost_after")) / F.col("cost_before") * 100, 9)).otherwise(0.0)  # sums in another order differ in their last digits
    return rows.withColumns({"improvement": gain, "modified": F.size("strategies") > 0})


#: strategy -> what it does
DESCRIPTIONS = {"OptionReorder": "cheap checks come before costly ones", "FastPattern": "the best content is the fast pattern", "RedundancyRemoval": "options that repeat an earlier one go"}


def records(optimized: DataFrame) -> DataFrame:
    """Adds records: for each strategy that changed the rule (strategy, description, gain, before, after, details), texts as the printer gives them."""
    from ..functions.printer import rule_text

    texts = let(optimized.withColumn("_options", F.col("options")), _before=rule_text()).withColumn("options", F.col("optimized"))
    texts = let(texts, _after=rule_text()).withColumn("options", F.col("_options")).drop("_options")
    said = "CASE s " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in DESCRIPTIONS.items()) + " END"
    made = "transform(strategies, s -> named_struct('strategy', s, 'description', " + said + ", 'gain', improvement, 'before', _before, 'after', _after, 'details', map('options_before', size(options), 'options_after', size(optimized))))"
    return let(texts, records=F.expr(made)).drop("_before", "_after")


def optimizer_statistics(optimized: DataFrame) -> DataFrame:
    """One row: totals, rate, the mean and largest of positive improvements, and how often each strategy changed a rule."""
    better = F.when(F.col("improvement") > 0, F.col("improvement"))
    n = F.count(F.lit(1))
    return optimized.agg(
        n.alias("total"),
        F.count_if("modified").alias("modified"),
        F.coalesce(F.count_if("modified") / n * 100, F.lit(0.0)).alias("rate_pct"),
        F.coalesce(F.avg(better), F.lit(0.0)).alias("avg_improvement"),
        F.coalesce(F.max(better), F.lit(0.0)).alias("max_improvement"),
        F.coalesce(F.sum(F.size("strategies")), F.lit(0)).alias("optimizations"),
        *[F.coalesce(F.sum(F.expr(f"size(filter(strategies, s -> s = '{name}'))")), F.lit(0)).alias(alias) for name, alias in STRATEGIES.items()],
    )
