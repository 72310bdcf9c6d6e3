"""Command line: python -m sigspark.cli parse|fmt|validate|stats|to-json|from-json|schema|plugins."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions.printer import PRESETS, rule_text
from .operators import analysis, reports
from .operators.pipeline import Validate, missing_lua_scripts
from .plugins import KINDS, load_folder, registry
from .sources.readers import from_json, from_texts, guard_path, read_rules
from .sources.writers import schema_text, write_json, write_text


def _session() -> SparkSession:
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("sigspark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _rules(args) -> DataFrame:
    if args.path == "-":
        return from_texts(_session(), [x for x in sys.stdin.read().splitlines() if x.strip() and not x.lstrip().startswith("#")], args.dialect)
    path = args.path if "://" in args.path else guard_path(args.path, args.base)
    return read_rules(_session(), path, multiline=args.multiline, dialect=args.dialect)


def _parse(args) -> int:
    rules = _rules(args)
    good, bad = rules.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    print(f"{good} rules, {bad} errors")
    for r in rules.where("not ok").select("raw_text", F.expr("diagnostics[0].message").alias("message")).limit(args.errors).collect():
        print(f"  {r.message}: {r.raw_text[:80]}", file=sys.stderr)
    return 1 if not good and bad else 0


def _fmt(args) -> int:
    rules = _rules(args)
    texts = rules.select("raw_text", F.when(F.col("ok"), rule_text(args.style)).otherwise(F.col("raw_text")).alias("text"))
    if args.check:
        n = texts.where("raw_text <> text").count()
        print(f"{n} rules would change")
        return 1 if n else 0
    if args.output:
        write_text(rules.where("ok"), args.output, args.style)
        return 0
    for r in texts.toLocalIterator():
        print(r.text)
    return 0


def _validate(args) -> int:
    found = Validate()(_rules(args))
    if args.scripts:
        names = _session().createDataFrame([(x,) for x in args.scripts], "name string")
        for r in missing_lua_scripts(found, names).collect():
            print(f"missing script {r.script_name} (sid {r.sid})")
    counts = {r.level: r["count"] for r in found.select(F.explode("diagnostics.level").alias("level")).groupBy("level").count().collect()}
    print(", ".join(f"{n} {level}s" for level, n in sorted(counts.items())) or "no findings")
    return 1 if counts.get("error") or args.strict and counts.get("warning") else 0


def _stats(args) -> int:
    rules = _rules(args).where("ok")
    if args.format == "table":
        for r in analysis.statistics(rules).orderBy("dimension", F.desc("cnt"), "value").collect():
            print(f"{r.dimension:10s} {r.value:12s} {r.cnt:>9,d} {r.pct:5.1f}%")
        return 0
    found = reports.report(rules)
    print({"json": lambda: json.dumps(found.to_dict(), indent=2), "text": found.to_text, "markdown": found.to_markdown}[args.format]())
    return 0


def _to_json(args) -> int:
    write_json(_rules(args), args.output)
    return 0


def _from_json(args) -> int:
    spark = _session()
    like = from_texts(spark, []).drop("index")
    rows = spark.read.text(args.path)
    write_text(from_json(rows, "value", like).where("ok"), args.output)
    return 0


def _schema(args) -> int:
    print(schema_text(from_texts(_session(), []).drop("index")))
    return 0


def _plugins(args) -> int:
    if args.folder:
        loaded, failed = load_folder(args.folder)
        for name, why in failed.items():
            print(f"{name}: {why}", file=sys.stderr)
    for kind in KINDS:
        for name in registry.names(kind):
            print(f"{kind} {name}")
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigspark", description="Rules of intrusion detection, on Spark.")
    commands = top.add_subparsers(required=True)

    def command(name: str, run, reads: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        if reads:
            c.add_argument("path", help="files or folder; - reads standard input")
            c.add_argument("--dialect", choices=S.DIALECTS, default="suricata")
            c.add_argument("--multiline", action="store_true")
            c.add_argument("--base", help="files outside this folder are refused")
        return c

    command("parse", _parse).add_argument("--errors", type=int, default=20, help="how many errors are shown")
    c = command("fmt", _fmt)
    c.add_argument("--style", choices=sorted(PRESETS), default="standard")
    c.add_argument("--check", action="store_true")
    c.add_argument("--output")
    c = command("validate", _validate)
    c.add_argument("--strict", action="store_true")
    c.add_argument("--scripts", nargs="*", help="the scripts there are")
    command("stats", _stats).add_argument("--format", choices=("table", "text", "markdown", "json"), default="table")
    command("to-json", _to_json).add_argument("output")
    c = command("from-json", _from_json, reads=False)
    c.add_argument("path")
    c.add_argument("output")
    command("schema", _schema, reads=False)
    command("plugins", _plugins, reads=False).add_argument("--folder")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
