"""The coverage report: one pass over the rules, bounded results to the driver, three forms of text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .analysis import _SAMPLED, content_type

SECTIONS = ("protocol", "direction", "action", "content_type", "port")


def coverage(rules: DataFrame) -> DataFrame:
    """(section, value, cnt) of protocols, directions, actions, message classes, sampled ports, and the total, in one pass."""
    one = lambda section, value: F.array(F.struct(F.lit(section).alias("section"), value.cast("string").alias("value")))
    kind = F.when(content_type().isNotNull(), one("content_type", content_type())).otherwise(F.array().cast("array<struct<section:string,value:string>>"))
    ports = F.expr(f"transform({_SAMPLED}, p -> named_struct('section', 'port', 'value', cast(p as string)))")
    pairs = F.concat(one("total", F.lit("rules")), one("protocol", F.col("protocol")), one("direction", F.col("direction")), one("action", F.col("action")), kind, ports)
    return rules.select(F.inline(pairs)).groupBy("section", "value").agg(F.count(F.lit(1)).alias("cnt"))


@dataclass
class Report:
    """What coverage found, as numbers and as text. It holds at most a row a port and a few others."""

    total: int = 0
    counts: dict[str, dict[str, int]] = field(default_factory=dict)

    def uncovered(self) -> list[int]:
        return [p for p in S.COMMON_PORTS if str(p) not in self.counts.get("port", {})]

    def share(self, section: str, *values: str) -> float:
        return 100.0 * sum(self.counts.get(section, {}).get(v, 0) for v in values) / self.total if self.total else 0.0

    def gaps(self) -> list[dict[str, str]]:
        """gap_type, severity, description and advice."""
        if not self.total:
            return []
        out = []
        for p in self.uncovered():
            name = S.PORT_NAMES.get(p, "Unknown")
            out.append(("port", "high" if p in S.HIGH_PORTS else "medium", f"no rule covers port {p} ({name})", f"add rules for {name} on port {p}"))
        tcp, udp, icmp = (self.share("protocol", x) for x in ("tcp", "udp", "icmp"))
        many = self.total >= 100
        checks = (
            (tcp > 95, "protocol", "medium", f"{tcp:.1f}% of the rules are TCP", "review attacks over UDP, such as amplification"),
            (udp < 2 and many, "protocol", "medium", f"only {udp:.1f}% of the rules are UDP", "add rules for DNS, NTP and SNMP"),
            (icmp < 0.5 and many, "protocol", "low", f"only {icmp:.1f}% of the rules are ICMP", "add rules for sweeps and tunnels"),
            (self.share("direction", "<-") < 2 and many, "direction", "medium", f"only {self.share('direction', '<-'):.1f}% of the rules look outbound", "add rules for exfiltration and callbacks"),
            (self.share("action", "drop", "reject") < 1 and many, "action", "low", f"only {self.share('action', 'drop', 'reject'):.1f}% of the rules block", "let sure alerts drop or reject"),
        )
        out += [c[1:] for c in checks if c[0]]
        return [dict(zip(("gap_type", "severity", "description", "advice"), x)) for x in out]

    def to_dict(self) -> dict:
        named = {f"{k}_distribution": self.counts.get(k, {}) for k in ("protocol", "direction", "action")}
        return {
            "total_rules": self.total, **named, "content_types": self.counts.get("content_type", {}), "port_coverage": self.counts.get("port", {}),
            "common_ports_uncovered": self.uncovered(), "gaps": self.gaps(),
        }

    def _ranked(self, section: str, top: int | None = None) -> list[tuple[str, int, float]]:
        rows = sorted(self.counts.get(section, {}).items(), key=lambda x: (-x[1], x[0]))[:top]
        return [(k, n, 100.0 * n / self.total if self.total else 0.0) for k, n in rows]

    def to_text(self) -> str:
        out = [f"Coverage of {self.total:,} rules"]
        for section in ("protocol", "direction", "action", "content_type"):
            out += ["", section.replace("_", " ")] + [f"  {k:20s} {n:>9,d} {p:5.1f}%" for k, n, p in self._ranked(section, 10 if section == "content_type" else None)]
        out += ["", f"ports covered: {len(self.counts.get('port', {})):,}"] + [f"  uncovered: {p} {S.PORT_NAMES.get(p, '')}" for p in self.uncovered()]
        out += ["", "gaps"] + [f"  [{g['severity']}] {g['description']}: {g['advice']}" for g in self.gaps()]
        return "\n".join(out)

    def to_markdown(self) -> str:
        out = ["# Coverage", "", f"{self.total:,} rules"]
        for section in ("protocol", "direction", "action", "content_type"):
            out += ["", f"## {section.replace('_', ' ').capitalize()}", "", "| Value | Rules | Share |", "|---|---:|---:|"]
            out += [f"| {k} | {n:,} | {p:.1f}% |" for k, n, p in self._ranked(section, 10 if section == "content_type" else None)]
        out += ["", "## Ports", "", f"{len(self.counts.get('port', {})):,} covered"] + [f"- {p} ({S.PORT_NAMES.get(p, '')}) is not" for p in self.uncovered()]
        out += ["", "## Gaps", ""] + [f"- **{g['severity']}** {g['description']}: {g['advice']}" for g in self.gaps()]
        return "\n".join(out)


def report(rules: DataFrame) -> Report:
    out = Report()
    for r in coverage(rules).collect():  # at most 65,536 ports and the vocabularies
        if r.section == "total":
            out.total = r.cnt
        else:
            out.counts.setdefault(r.section, {})[r.value] = r.cnt
    return out
