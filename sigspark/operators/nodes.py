"""Rules as node arrays in pre-order: Rule, Header, address and port leaves, options."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let

#: attribute -> SQL of its text, for options (o)
OPTION_ATTRS = {
    "text": "o.text", "value": "coalesce(cast(o.value_int as string), o.value_str)", "ref_type": "o.ref_type", "ref_id": "o.ref_id",
    "pattern": "coalesce(o.pattern_str, cast(o.pattern as string))", "flags": "o.flags", "directions": "array_join(o.directions, ',')", "states": "array_join(o.states, ',')",
    "action": "o.action", "name": "o.name", "buffer_name": "o.buffer_name", "offset": "cast(o.offset as string)", "length": "cast(o.length as string)",
    "direction": "o.direction", "scope": "o.scope", "script_name": "o.script_name", "keyword": "if(o.node_type = 'GenericOption', o.keyword, null)",
    "raw": "if(o.node_type = 'GenericOption', o.raw, null)", "entries": "array_join(transform(o.entries, e -> concat(e.key, ' ', e.value)), ',')",
    "modifiers": "array_join(o.modifiers.name, ',')", "node_type": "o.node_type",
}
LEAF_ATTRS = {"address": ("value", "version", "network", "prefix_len", "start", "end", "name"), "port": ("value", "start", "end", "name")}


Names = frozenset | None


def _map(pairs: dict[str, str], names: Names = None) -> str:
    """SQL for a map of those of the pairs that have a value; only the names that are asked for."""
    entries = ", ".join(f"struct('{k}' as key, {v} as value)" for k, v in pairs.items() if names is None or k in names)
    return f"map_from_entries(filter(array({entries}), e -> e.value is not null))" if entries else "cast(map() as map<string, string>)"


def rule_attrs(names: Names = None) -> str:
    return _map({"action": "action", "dialect": "dialect", "raw_text": "raw_text", "node_type": "'Rule'"}, names)


def header_attrs(names: Names = None) -> str:
    sides = {c: f"if(size({c}.atoms) = 1 and {c}.kind = 'single', coalesce(cast({c}.atoms[0].value as string), {c}.text), {c}.text)" for c in ("src_addr", "src_port", "dst_addr", "dst_port")}
    return _map({"protocol": "protocol", "direction": "direction", "node_type": "'Header'"} | sides, names)


def option_attrs(names: Names = None) -> str:
    return _map(OPTION_ATTRS, names)


def _leaves(column: str, kind: str) -> str:
    pairs = {k: f"cast(a.`{k}` as string)" for k in LEAF_ATTRS[kind]} | {"node_type": "a.node_type"}
    key = "concat_ws('|', a.node_type, cast(a.negated as string), " + ", ".join(f"cast(a.`{k}` as string)" for k in LEAF_ATTRS[kind]) + ")"
    return f"transform({column}.atoms, a -> named_struct('node_type', a.node_type, 'attrs', {_map(pairs)}, 'key', {key}, 'ordinal', cast(null as int), 'kids', false))"


def with_nodes(rules: DataFrame, names: Names = None) -> DataFrame:
    """Adds nodes: array of (pos, parent, sib, first_equal, last_sib, node_type, attrs, key, ordinal, has_children).

    names: the attributes that attrs must hold for Rule, Header and options (all, if not given).
    """
    option = f"named_struct('node_type', o.node_type, 'attrs', {option_attrs(names)}, 'key', concat(o.node_type, '|', o.raw), 'ordinal', o.ordinal, 'kids', coalesce(size(o.modifiers), 0) + coalesce(size(o.entries), 0) + coalesce(size(o.states), 0) + coalesce(size(o.directions), 0) > 0)"
    leaves = ", ".join(_leaves(c, "port" if c.endswith("port") else "address") for c in ("src_addr", "src_port", "dst_addr", "dst_port"))
    rows = let(rules, _leaf=F.expr(f"concat({leaves})"), _opt=F.expr(f"transform(options, o -> {option})"))
    top = f"array(named_struct('node_type', 'Rule', 'attrs', {rule_attrs(names)}, 'key', 'Rule', 'ordinal', cast(null as int), 'kids', true), named_struct('node_type', 'Header', 'attrs', {header_attrs(names)}, 'key', 'Header', 'ordinal', cast(null as int), 'kids', true))"
    rows = let(rows, _all=F.expr(f"concat({top}, _leaf, _opt)"), _nl=F.size("_leaf"), _okeys=F.expr("_opt.key"), _lkeys=F.expr("_leaf.key"))
    made = F.expr(
        """transform(_all, (n, i) -> named_struct('pos', i, 'parent', CASE WHEN i = 0 THEN -1 WHEN i = 1 THEN 0 WHEN i < 2 + _nl THEN 1 ELSE 0 END,
             'sib', CASE WHEN i < 2 THEN 0 WHEN i < 2 + _nl THEN i - 2 ELSE i - 1 - _nl END,
             'first_equal', CASE WHEN i < 2 THEN 0 WHEN i < 2 + _nl THEN cast(array_position(_lkeys, n.key) as int) - 1 ELSE cast(array_position(_okeys, n.key) as int) END,
             'last_sib', CASE WHEN i = 0 THEN 0 WHEN i = 1 THEN size(_okeys) WHEN i < 2 + _nl THEN _nl - 1 ELSE size(_okeys) END,
             'is_last', CASE WHEN i = 0 THEN true WHEN i = 1 THEN size(_okeys) = 0 WHEN i < 2 + _nl THEN n.key = element_at(_lkeys, -1) ELSE n.key = try_element_at(_okeys, -1) END,
             'node_type', n.node_type, 'attrs', n.attrs, 'key', n.key, 'ordinal', n.ordinal, 'has_children', n.kids))"""
    )
    return let(rows, nodes=made).drop("_leaf", "_opt", "_all", "_nl", "_okeys", "_lkeys")
