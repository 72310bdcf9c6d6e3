"""The cost model of rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S
from .columns import quoted, sql_case


def _product(items: str, factor: str) -> str:
    return f"aggregate({items}, 1.0D, (p, m) -> p * {factor})"


def option_cost(o: str) -> str:
    """SQL for the cost of one option by itself."""
    modifiers = _product(f"coalesce({o}.modifiers, array())", sql_case("m.name", S.MODIFIER_FACTORS, "1.0D", "D"))
    content = f"10.0D * CASE WHEN length({o}.pattern) > 20 THEN 1.2D WHEN length({o}.pattern) < 4 THEN 1.3D ELSE 1.0D END * {modifiers}"
    p = f"{o}.pattern_str"
    flags = _product(f"filter(split({o}.flags, ''), f -> f <> '')", sql_case("m", S.PCRE_FLAG_FACTORS, "1.0D", "D"))
    bars = f"(length({p}) - length(replace({p}, '|', '')))"
    pcre = (
        f"100.0D * if(length({p}) > 50, 1.5D, 1.0D) * if(contains({p}, '.*') or contains({p}, '.+'), 1.4D, 1.0D) * (1.0D + 0.1D * {bars}) "
        f"* if(contains({p}, '(?:') or contains({p}, '(?=') or contains({p}, '(?!'), 1.3D, 1.0D) * {flags}"
    )
    plain = sql_case(f"{o}.node_type", S.BASE_COSTS, f"{S.DEFAULT_COST}D", "D")
    return f"CASE WHEN {o}.node_type = 'ContentOption' THEN {content} WHEN {o}.node_type = 'PcreOption' THEN {pcre} ELSE {plain} END"


_BINDS = {"DepthOption": "depth", "OffsetOption": "offset", "DistanceOption": "distance", "WithinOption": "within", "FastPatternOption": "fast_pattern"}
_KEEPS = (*_BINDS, "NocaseOption", "RawbytesOption", "StartswithOption", "EndswithOption")


def rule_cost(options: str = "options") -> Column:
    """The cost of a rule: a left fold in which position modifiers rescale the content before them."""
    change = sql_case("o.node_type", {k: 10.0 * S.MODIFIER_FACTORS[v] - 10.0 for k, v in _BINDS.items()}, "0.0D", "D")
    binds = ", ".join(quoted(x) for x in _BINDS)
    keeps = ", ".join(quoted(x) for x in _KEEPS)
    return F.expr(
        f"""aggregate({options}, named_struct('t', 0.0D, 'live', false),
          (a, o) -> named_struct('t', a.t + if(a.live and o.node_type in ({binds}), {change}, {option_cost('o')}),
                                 'live', o.node_type = 'ContentOption' or (a.live and o.node_type in ({keeps}))), a -> a.t)"""
    )


def position_penalty(options: str = "options") -> Column:
    """Sum of each option's cost over its place."""
    return F.expr(f"aggregate(transform({options}, (o, i) -> ({option_cost('o')}) / (i + 1)), 0.0D, (a, x) -> a + x)")
