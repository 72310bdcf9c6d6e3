"""Reading rules: text files by line or by logical rule, strings, JSON."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.lineage import cut
from ..operators.parse import parse

ACTION_START = r"^(?:" + "|".join(S.ACTIONS) + r")\b"


def guard_path(path: str, allowed_base: str | None = None, allow_symlinks: bool = False) -> str:
    """Refuses symbolic links and paths outside allowed_base; error texts name the last part only."""
    if os.path.islink(path) and not allow_symlinks:
        raise ValueError(f"{os.path.basename(path)} is a symbolic link")
    real = os.path.realpath(path)
    if allowed_base and os.path.commonpath([real, os.path.realpath(allowed_base)]) != os.path.realpath(allowed_base):
        raise ValueError(f"{os.path.basename(path)} is outside the allowed folder")
    return real


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file_path, line_no (from 1) and text of every line; one file is one task, as rule files are small."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(F.split("value", "\r?\n", -1)).alias("line_no", "text"))
    return files.withColumn("line_no", F.col("line_no") + 1)


def assemble(lines: DataFrame) -> DataFrame:
    """Logical rules from lines: file_path, start_line, end_line, text.

    A blank line and a line that starts with an action end what came before; comments are skipped; a rule whose
    parentheses balance at a closing one ends there, so text after it is a record of its own.
    """
    rows = lines.withColumn("text", F.trim("text")).where("not text like '#%'")
    order = Window.partitionBy("file_path").orderBy("line_no")
    starts = (F.col("text") == "") | F.col("text").rlike(ACTION_START)
    rows = rows.withColumn("_rec", F.sum(starts.cast("int")).over(order)).where("text <> ''")
    inside = Window.partitionBy("file_path", "_rec").orderBy("line_no")
    opened = F.sum(F.length(F.regexp_replace("text", r"[^(]", ""))).over(inside)
    closed = F.sum(F.length(F.regexp_replace("text", r"[^)]", ""))).over(inside)
    done = (F.col("text").endswith(")") & (opened == closed) & (opened > 0)).cast("int")
    rows = rows.withColumn("_done", done).withColumn("_part", F.coalesce(F.sum("_done").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    made = rows.groupBy("file_path", "_rec", "_part").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return made.select("file_path", F.expr("l[0].line_no").alias("start_line"), F.expr("element_at(l, -1).line_no").alias("end_line"), F.array_join("l.text", " ").alias("text"))


def read_rules(spark: SparkSession, path: str, multiline: bool = False, dialect: str = "suricata", keep_errors: bool = True, allowed_base: str | None = None) -> DataFrame:
    """Rules of text files, parsed; line by line, or assembled over lines. Paths of this machine are checked if allowed_base is given."""
    if allowed_base is not None:
        path = guard_path(path, allowed_base)
    lines = raw_lines(spark, path)
    rows = assemble(lines) if multiline else lines.where("trim(text) <> '' and not trim(text) like '#%'")
    rules = parse(rows, "text", dialect=dialect).drop("text")
    return rules if keep_errors else rules.where("ok")


def parse_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """read_rules, but files in which there are rules and none is valid raise ParseError."""
    rules = read_rules(spark, path, **options)
    good, bad = rules.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
    if bad and not good:
        raise S.ParseError(f"none of {bad} rules is valid")
    return rules


def from_texts(spark: SparkSession, texts: Iterable[str], dialect: str = "suricata") -> DataFrame:
    """Rules of strings, with their index; errors are error rules."""
    return parse(spark.createDataFrame(list(enumerate(texts)), "index long, text string"), "text", dialect=dialect)


def batches(rules: DataFrame, order: str, size: int = 1000, partition: str | None = None) -> DataFrame:
    """batch_number, start, end, success_count and error_count of runs of ``size`` rules in order.

    Row numbers come from per-partition counts after a range partitioning: no task sees all rows.
    """
    numbered = rules.select(order, "ok").repartitionByRange(order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    parts = cut(numbered.withColumn("_p", F.shiftright("_id", 33)))  # read twice: the numbers must be the same
    before = parts.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = parts.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn("_row", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1))
    return rows.groupBy(F.expr(f"_row div {size}").alias("batch_number")).agg(
        (F.min("_row") + 1).alias("start"), (F.max("_row") + 1).alias("end"), F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("error_count")
    )


def from_json(df: DataFrame, column: str, like: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Rules of lossless JSON texts, in the schema of ``like``, with the columns of df to keep."""
    return df.select(F.from_json(column, like.schema).alias("_r"), *keep).select("_r.*", *keep)


def from_envelopes(df: DataFrame, column: str, like: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Rules of JSON envelopes, of one rule or a list, in the schema of ``like``; another version fails the query."""
    from pyspark.sql import types as T

    one = like.schema
    kind = lambda data: T.StructType([T.StructField("ast_version", T.StringType()), T.StructField("data", data)])
    rows = df.select(F.from_json(column, kind(T.StructType([T.StructField("rules", T.ArrayType(one))]))).alias("m"), F.from_json(column, kind(one)).alias("s"))
    wrong = F.raise_error(F.concat(F.lit("unknown version "), F.coalesce("s.ast_version", F.lit("none"))))
    rules = F.when(F.col("s.ast_version").eqNullSafe(version), F.coalesce("m.data.rules", F.array("s.data"))).otherwise(wrong)
    return rows.select(F.inline(rules))


def assemble_legacy(lines: DataFrame) -> DataFrame:
    """Logical rules from lines by their ends alone: file_path, start_line, end_line, text.

    A line that ends with a semicolon ends the rule, and one that ends with a closing parenthesis does if an opening
    one came since the last line of either end (before that, it was part of an ended rule or there was none).
    """
    rows = lines.withColumn("text", F.trim("text")).where("text <> '' and not text like '#%'")
    order = Window.partitionBy("file_path").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("text").rlike("[;)]$").cast("int")
    rows = rows.withColumn("_seg", F.coalesce(F.sum(ends).over(before), F.lit(0)))
    opened = F.max(F.contains("text", F.lit("(")).cast("int")).over(Window.partitionBy("file_path", "_seg"))
    rows = rows.withColumn("_done", (F.col("text").endswith(";") | (F.col("text").endswith(")") & (opened == 1))).cast("int"))
    rows = rows.withColumn("_rec", F.coalesce(F.sum("_done").over(before), F.lit(0)))
    made = rows.groupBy("file_path", "_rec").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("l"))
    return made.select("file_path", F.expr("l[0].line_no").alias("start_line"), F.expr("element_at(l, -1).line_no").alias("end_line"), F.array_join("l.text", " ").alias("text"))
