"""A fluent builder of rule texts, for single rules and for columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import schema as S


class RuleBuilder:
    """RuleBuilder().alert().tcp().source("any").to("$HOME_NET", "80").msg("x").content("GET", nocase=True).sid(1).build()"""

    def __init__(self) -> None:
        self._head: dict[str, str] = {"direction": "->"}
        self._options: list[str] = []

    def action(self, value: str) -> RuleBuilder:
        if value not in S.ACTIONS:
            raise S.BuilderError(f"no such action: {value}")
        self._head["action"] = value
        return self

    def protocol(self, value: str) -> RuleBuilder:
        if value not in S.PROTOCOLS:
            raise S.BuilderError(f"no such protocol: {value}")
        self._head["protocol"] = value
        return self

    def __getattr__(self, name: str):
        plain = name.rstrip("_")
        if plain in S.ACTIONS:
            return lambda: self.action(plain)
        if plain in S.PROTOCOLS:
            return lambda: self.protocol(plain)
        if plain in ("rev", "gid", "classtype", "priority", "flowbits", "threshold", "detection_filter", "byte_test", "byte_jump", "byte_extract", "tag", "filestore", "lua", "luajit", "fast_pattern", "depth", "offset", "distance", "within"):
            return lambda *v: self.option(plain, ",".join(map(str, v)) or None)
        raise AttributeError(name)

    def source(self, address: str = "any", port: str | int = "any") -> RuleBuilder:
        self._head |= {"src_addr": address, "src_port": str(port)}
        return self

    def to(self, address: str = "any", port: str | int = "any") -> RuleBuilder:
        self._head |= {"dst_addr": address, "dst_port": str(port)}
        return self

    def direction(self, value: str) -> RuleBuilder:
        if value not in S.DIRECTIONS:
            raise S.BuilderError(f"no such direction: {value}")
        self._head["direction"] = value
        return self

    def bidirectional(self) -> RuleBuilder:
        return self.direction("<>")

    def option(self, keyword: str, value: str | None = None) -> RuleBuilder:
        self._options.append(keyword if value is None else f"{keyword}:{value}")
        return self

    @staticmethod
    def _quote(text: str) -> str:
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def msg(self, text: str) -> RuleBuilder:
        return self.option("msg", self._quote(text))

    def sid(self, value: int) -> RuleBuilder:
        if value < 1:
            raise S.BuilderError("sid must be 1 or more")
        return self.option("sid", str(value))

    def reference(self, kind: str, value: str) -> RuleBuilder:
        return self.option("reference", f"{kind},{value}")

    def metadata(self, **entries: str) -> RuleBuilder:
        return self.option("metadata", ", ".join(f"{k} {v}" for k, v in entries.items()))

    def content(self, pattern: str | bytes, **modifiers) -> RuleBuilder:
        """modifiers: nocase=True, depth=5, ...; bytes are written as hex where they are not printable."""
        raw = pattern.encode() if isinstance(pattern, str) else pattern
        text = "".join(chr(b) if 32 <= b < 127 and chr(b) not in '|\\";' else f"|{b:02X}|" for b in raw)
        more = "".join(f",{k}" if v is True else f",{k} {v}" for k, v in modifiers.items() if v is not False)
        return self.option("content", f'"{text}"{more}')

    def pcre(self, pattern: str, flags: str = "") -> RuleBuilder:
        return self.option("pcre", f'"/{pattern}/{flags}"')

    def flow(self, *values: str) -> RuleBuilder:
        bad = [v for v in values if v not in (*S.FLOW_DIRECTIONS, *S.FLOW_STATES)]
        if not values or bad:
            raise S.BuilderError(f"no such flow: {', '.join(bad)}" if bad else "flow needs a value")
        return self.option("flow", ",".join(values))

    def content_builder(self) -> ContentBuilder:
        return ContentBuilder(self)

    def flow_builder(self) -> FlowBuilder:
        return FlowBuilder(self)

    def threshold_builder(self, keyword: str = "threshold") -> ThresholdBuilder:
        return ThresholdBuilder(self, keyword)

    def buffer(self, name: str) -> RuleBuilder:
        return self.option(name)

    def build(self) -> str:
        lack = [k for k in ("action", "protocol", "src_addr", "src_port", "dst_addr", "dst_port") if k not in self._head]
        if lack:
            raise S.BuilderError(f"missing: {', '.join(lack)}")
        head = " ".join(self._head[k] for k in ("action", "protocol", "src_addr", "src_port", "direction", "dst_addr", "dst_port"))
        return f"{head} ({' '.join(o + ';' for o in self._options)})"


class ContentBuilder:
    """Parts of a content, in the order of the calls: buffers before it, modifiers as options after it; ``done`` goes back to the rule."""

    def __init__(self, parent: RuleBuilder) -> None:
        self._parent, self._pattern, self._after = parent, None, []

    def pattern(self, value: str | bytes) -> ContentBuilder:
        self._pattern = value
        return self

    def __getattr__(self, name: str):
        dotted = name.replace("_", ".", 1)
        if name in S.BUFFERS:
            return lambda: (self._parent.buffer(dotted if name.startswith("tls") else name), self)[1]
        if name in ("nocase", "rawbytes", "startswith", "endswith", "fast_pattern"):
            return lambda: (self._after.append((name, None)), self)[1]
        if name in ("depth", "offset", "distance", "within"):
            return lambda value: (self._after.append((name, str(value))), self)[1]
        raise AttributeError(name)

    def done(self) -> RuleBuilder:
        if self._pattern is None:
            raise S.BuilderError("a content needs a pattern")
        self._parent.content(self._pattern)
        for name, value in self._after:
            self._parent.option(name, value)
        return self._parent


class FlowBuilder:
    """Directions and states of a flow option."""

    def __init__(self, parent: RuleBuilder) -> None:
        self._parent, self._values = parent, []

    def __getattr__(self, name: str):
        if name in (*S.FLOW_DIRECTIONS, *S.FLOW_STATES):
            return lambda: (self._values.append(name), self)[1]
        raise AttributeError(name)

    def done(self) -> RuleBuilder:
        return self._parent.flow(*self._values)


class ThresholdBuilder:
    """Type, track, count and seconds of a threshold (all four) or detection_filter (the last three)."""

    TYPES, TRACKS = ("limit", "threshold", "both"), ("by_src", "by_dst", "by_rule", "by_both")

    def __init__(self, parent: RuleBuilder, keyword: str = "threshold") -> None:
        self._parent, self._keyword, self._parts = parent, keyword, {}

    def threshold_type(self, value: str) -> ThresholdBuilder:
        return self._set("type", value, value in self.TYPES)

    def track(self, value: str) -> ThresholdBuilder:
        return self._set("track", value, value in self.TRACKS)

    def count(self, value: int) -> ThresholdBuilder:
        return self._set("count", value, value > 0)

    def seconds(self, value: int) -> ThresholdBuilder:
        return self._set("seconds", value, value > 0)

    def _set(self, name: str, value, ok: bool) -> ThresholdBuilder:
        if not ok:
            raise S.BuilderError(f"no such {name}: {value}")
        self._parts[name] = value
        return self

    def done(self) -> RuleBuilder:
        names = ("type", "track", "count", "seconds")[self._keyword != "threshold" :]
        lack = [x for x in names if x not in self._parts]
        if lack:
            raise S.BuilderError(f"{self._keyword} needs {', '.join(lack)}")
        return self._parent.option(self._keyword, ", ".join(f"{x} {self._parts[x]}" for x in names))


def build_column(action: Column, protocol: Column, src: Column, src_port: Column, direction: Column, dst: Column, dst_port: Column, *options: Column) -> Column:
    """Rule texts from columns; null options are left out."""
    return F.concat(F.concat_ws(" ", action, protocol, src, src_port, direction, dst, dst_port), F.lit(" ("), F.concat_ws(" ", *options), F.lit(")"))
