"""CSS-style selectors over rule nodes, compiled to Catalyst expressions.

A selector becomes one SQL expression over the ``nodes`` array of a rule: bounded lookups instead of a tree
walk, since a node has at most two ancestors. Combinators take the nearest match and do not retry. A
necessary condition on node types is added as a plain filter before the nodes are built.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, quoted
from ..schema import InvalidSelectorError, QueryExecutionError, QuerySyntaxError
from .nodes import header_attrs, option_attrs, rule_attrs, with_nodes

OPERATORS = ("=", "!=", ">=", "<=", ">", "<", "*=", "^=", "$=")
PSEUDO = ("first", "first-child", "last", "last-child", "empty", "not-empty", "has", "not", "even", "odd", "nth", "within")
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_TOKEN = re.compile(
    r"""(?P<ws>\s+)|(?P<name>[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*)|(?P<number>\d+(?:\.\d+)?)|(?P<string>"[^"]*"|'[^']*')"""
    r"""|(?P<op>!=|>=|<=|\*=|\^=|\$=|=)|(?P<pseudo>:[a-z]+(?:-[a-z]+)?)|(?P<punct>[*,>+~\[\]()<])"""
)


@dataclass
class Part:
    """A compound: type (None for *), attribute tests, pseudo-classes."""

    type: str | None = None
    attrs: list[tuple[str, str | None, str | None]] = field(default_factory=list)
    pseudos: list[tuple[str, list[Chain] | None]] = field(default_factory=list)
    universal: bool = False

    @property
    def compound(self) -> bool:
        return (self.type is not None) + self.universal + len(self.attrs) + len(self.pseudos) > 1


@dataclass
class Chain:
    parts: list[Part]
    combinators: list[str]


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
        out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str) -> None:
        self.t, self.i = _tokens(text), 0

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.t[self.i + k] if self.i + k < len(self.t) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.i += 1
        return self.t[self.i - 1]

    def space(self) -> bool:
        found = False
        while self.peek()[0] == "ws":
            self.i += 1
            found = True
        return found

    def union(self) -> list[Chain]:
        out = [self.chain()]
        while self.peek()[1] == ",":
            self.take()
            out.append(self.chain())
        return out

    def chain(self) -> Chain:
        self.space()
        parts, combinators = [self.part()], []
        while True:
            spaced = self.space()
            _, v = self.peek()
            if v in (">", "+", "~"):
                self.take()
                self.space()
                combinators.append(v)
            elif spaced and v not in ("", ",", ")"):
                combinators.append(" ")
            else:
                return Chain(parts, combinators)
            parts.append(self.part())

    def part(self) -> Part:
        p = Part()
        kind, v = self.peek()
        if kind == "name":
            p.type = self.take()[1]
        elif v == "*":
            self.take()
            p.universal = True
        while True:
            kind, v = self.peek()
            if v == "[":
                self.take()
                p.attrs.append(self.attribute())
            elif kind == "pseudo":
                p.pseudos.append(self.pseudo())
            else:
                break
        if p.type is None and not p.universal and not p.attrs and not p.pseudos:
            raise QuerySyntaxError("a selector is missing")
        return p

    def attribute(self) -> tuple[str, str | None, str | None]:
        self.space()
        kind, name = self.peek()
        if kind != "name":
            raise QuerySyntaxError("an attribute name is missing")
        self.take()
        self.space()
        if self.peek()[1] == "]":
            self.take()
            return name, None, None
        op = self.take()[1] if self.peek()[0] != "end" else ""
        if op not in OPERATORS:
            raise InvalidSelectorError(f"no such operator: {op!r}")
        self.space()
        kind, v = self.peek()
        if kind not in ("string", "number", "name"):
            raise QuerySyntaxError("a value is missing")
        self.take()
        self.space()
        if self.peek()[1] != "]":
            raise QuerySyntaxError("] is missing")
        self.take()
        return name, op, v[1:-1] if kind == "string" else v

    def pseudo(self) -> tuple[str, list[Chain] | None]:
        name = self.take()[1][1:]
        if name not in PSEUDO:
            raise InvalidSelectorError(f"no such pseudo-class: {name}")
        inner = None
        if self.peek()[1] == "(":
            self.take()
            if name in ("nth", "within"):
                while self.peek()[1] not in (")", ""):
                    self.take()
            elif self.peek()[1] != ")":
                inner = self.union()
            if self.peek()[1] != ")":
                raise QuerySyntaxError(") is missing")
            self.take()
        return name, inner


def parse_selector(text: str) -> list[Chain]:
    """The chains of a selector; commas separate them."""
    if not text or not text.strip():
        raise QuerySyntaxError("the selector is empty")
    p = _Parser(text.strip())
    out = p.union()
    if p.peek()[0] != "end":
        raise QuerySyntaxError(f"unexpected {p.peek()[1]!r}")
    return out


def _attr(n: str, name: str, op: str | None, value: str | None) -> str:
    if "." in name:
        return "false"
    got = f"{n}.attrs[{quoted(name)}]"
    if op is None:
        return f"{got} is not null"
    v = quoted(value)
    if op in ("=", "!="):
        return f"coalesce({got} {'=' if op == '=' else '<>'} {v}, false)"
    if op in ("*=", "^=", "$="):
        return f"coalesce({dict(zip(('*=', '^=', '$='), ('contains', 'startswith', 'endswith')))[op]}({got}, {v}), false)"
    if not re.match(NUMBER, value):
        return "false"
    return f"coalesce(if({got} rlike {quoted(NUMBER)}, try_cast(trim({got}) as double) {op} {float(value)!r}D, false), false)"


class _Compiler:
    def __init__(self) -> None:
        self.n = 0

    def name(self) -> str:
        self.n += 1
        return f"x{self.n}"

    def part(self, p: Part, n: str, context: bool = True) -> str:
        tests = [f"{n}.node_type = {quoted(p.type)}"] if p.type else []
        tests += [_attr(n, *a) for a in p.attrs]
        tests += [self.pseudo(name, inner, n, context and not p.compound) for name, inner in p.pseudos]
        return "(" + (" and ".join(tests) or "true") + ")"

    def pseudo(self, name: str, inner: list[Chain] | None, n: str, context: bool) -> str:
        if name in ("first", "first-child"):
            return f"{n}.first_equal = 0" if context else "true"
        if name in ("last", "last-child"):
            return f"{n}.is_last" if context else "true"
        if name == "empty":
            return f"not {n}.has_children"
        if name == "not-empty":
            return f"{n}.has_children"
        if name == "has":
            if inner is None:
                return "false"
            d = self.name()
            below = f"({d}.parent = {n}.pos or ({n}.pos = 0 and {d}.pos > 0)) and not ({d}.node_type = {n}.node_type and {d}.key = {n}.key)"
            return f"exists(nodes, {d} -> {below} and ({' or '.join(self.chain(c, d) for c in inner)}))"
        if name == "not":
            return "true" if inner is None else "not (" + " or ".join(self.part(c.parts[-1], n) for c in inner) + ")"
        return "false"

    def chain(self, c: Chain, n: str) -> str:
        """Whether n matches the chain: its last part, then step by step to the left from the nearest match."""
        test = self.part(c.parts[-1], n)
        return test if not c.combinators else f"({test} and {self.step(c, len(c.combinators) - 1, n, n, True)})"

    def step(self, c: Chain, k: int, origin: str, at: str, stacked: bool) -> str:
        if k < 0:
            return f"{at} is not null"
        part, comb = c.parts[k], c.combinators[k]
        a, b = self.name(), self.name()
        if comb == " ":
            if stacked:
                scope = f"({a}.pos = {at}.parent or {a}.pos = nodes[greatest({at}.parent, 0)].parent)"
            else:
                scope = f"({a}.pos in ({origin}.pos, {origin}.parent) or {a}.pos = nodes[greatest({origin}.parent, 0)].parent) and {a}.key <> {at}.key"
        elif not stacked:
            return "false"  # a sibling found by + or ~ is not on the path from the root
        elif comb == ">":
            scope = f"{a}.pos = {at}.parent"
        elif comb == "+":
            scope = f"{a}.parent = {at}.parent and {at}.parent >= 0 and {a}.sib = {at}.first_equal - 1"
        else:
            scope = f"{a}.parent = {at}.parent and {at}.parent >= 0 and {a}.sib < {at}.first_equal"
        order = "transform(array_sort(transform(filter(nodes, {a} -> {scope} and {test}), {a} -> struct({a}.{by} as o, {a}.pos as pos))), {a} -> nodes[{a}.pos])"
        near = "try_element_at(" + order.format(a=a, scope=scope, test=self.part(part, a), by="sib" if comb in "+~" else "pos") + ", -1)"
        rest = self.step(c, k - 1, origin, b, stacked and comb in (" ", ">"))
        return f"transform(array({near}), {b} -> coalesce({b} is not null and {rest}, false))[0]"


def compile_selector(selector: str) -> str:
    """SQL for the matching nodes of the array ``nodes``: chain by chain, each in document order, each node once."""
    found = []
    for c in parse_selector(selector):
        compiler = _Compiler()
        found.append(f"filter(nodes, x0 -> {compiler.chain(c, 'x0')})")
    if len(found) == 1:
        return found[0]
    positions = ", ".join(f"transform({f}, y -> y.pos)" for f in found)
    return f"transform(array_distinct(concat({positions})), p -> nodes[p])"


def _needed(selector: str) -> str | None:
    """A condition on the rule's options without which nothing matches."""
    types = []
    for c in parse_selector(selector):
        t = c.parts[-1].type
        if t is None or not t.endswith("Option"):
            return None
        types.append(t)
    return f"exists(options, o -> o.node_type in ({', '.join(quoted(t) for t in types)}))"


def _names(chains: list[Chain]) -> frozenset:
    """The attributes that a selector tests."""
    out = set()
    for part in (p for c in chains for p in c.parts):
        out |= {name for name, _, _ in part.attrs}
        for _, inner in part.pseudos:
            out |= _names(inner or [])
    return frozenset(out)


#: All attributes of a matching node n, for those that come out
_ALL_ATTRS = f"""CASE WHEN n.ordinal is not null THEN transform(array(options[n.ordinal]), o -> {option_attrs()})[0]
  WHEN n.pos = 0 THEN {rule_attrs()} WHEN n.pos = 1 THEN {header_attrs()} ELSE n.attrs END"""


def _matched(rules: DataFrame, selector: str) -> DataFrame:
    needed = _needed(selector)
    rows = rules.where(needed) if needed else rules
    try:
        return let(with_nodes(rows, _names(parse_selector(selector))), _found=F.expr(compile_selector(selector)))
    except (QuerySyntaxError, InvalidSelectorError):
        raise
    except Exception as e:  # what Catalyst refuses
        raise QueryExecutionError(str(e)) from e


def query(rules: DataFrame, selector: str) -> DataFrame:
    """One row a matching node: the rule's columns, rank (place in the result), pos, node_type, attrs and the option or null."""
    rows = _matched(rules, selector)
    out = rows.select(*[F.col(c) for c in rules.columns], F.posexplode("_found").alias("rank", "n"))
    return out.select(*rules.columns, "rank", "n.pos", "n.node_type", F.expr(_ALL_ATTRS).alias("attrs"), F.get("options", F.col("n.ordinal")).alias("option"))


def query_first(rules: DataFrame, selector: str) -> DataFrame:
    """The first match of each rule that has one."""
    rows = _matched(rules, selector).where("size(_found) > 0")
    rows = let(rows.select(*rules.columns, F.expr("_found[0]").alias("n")), attrs=F.expr(_ALL_ATTRS))
    return rows.select(*rules.columns, "n.pos", "n.node_type", "attrs")


def query_exists(rules: DataFrame, selector: str) -> DataFrame:
    """The rules with a match."""
    return _matched(rules, selector).where("size(_found) > 0").select(*rules.columns)


class QueryResult:
    """A lazy result: filter, map to columns, count, first, rules."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df

    def filter(self, condition) -> QueryResult:
        return QueryResult(self.df.where(condition))

    def select(self, *columns) -> DataFrame:
        return self.df.select(*columns)

    def count(self) -> int:
        return self.df.count()

    def first(self):
        return self.df.orderBy("raw_text", "rank").first()


class Q:
    """Builds selector texts: Q("ContentOption").attr("pattern", "*=", "x").inside("Rule")."""

    def __init__(self, text: str = "*") -> None:
        self.text = text

    def attr(self, name: str, op: str | None = None, value=None) -> Q:
        return Q(f"{self.text}[{name}]" if op is None else f'{self.text}[{name}{op}"{value}"]')

    def pseudo(self, name: str, inner: str | None = None) -> Q:
        return Q(f"{self.text}:{name}" + (f"({inner})" if inner else ""))

    def inside(self, outer: str) -> Q:
        return Q(f"{outer} {self.text}")

    def child_of(self, outer: str) -> Q:
        return Q(f"{outer} > {self.text}")

    def after(self, other: str) -> Q:
        return Q(f"{other} + {self.text}")

    def either(self, other: Q) -> Q:
        return Q(f"{self.text}, {other.text}")

    def run(self, rules: DataFrame) -> QueryResult:
        return QueryResult(query(rules, self.text))
