"""Rule texts derived from tables, so that the engine runs over data of any size.

Every event gives one rule whose parts follow from its id, user and type; the parser reads the text like any
other. The SQL in ``catalogue`` states what must come out from the columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..builder import build_column
from ..operators.parse import parse

ACTIONS = "array('alert', 'log', 'pass', 'drop', 'reject', 'sdrop')"
PROTOCOLS = "array('tcp', 'udp', 'icmp', 'http', 'dns')"


def texts_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and text: one rule for each event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id", "event_type")
    e = e.repartition(spark.sparkContext.defaultParallelism)  # a file of one row group is one task
    x = F.expr
    when = lambda c, v: x(f"if({c}, {v}, null)")
    text = build_column(
        x(f"{ACTIONS}[id % 6]"), x(f"{PROTOCOLS}[id % 5]"),
        x("array('any', '$HOME_NET', concat('10.0.', id % 256, '.1'), concat('[10.', id % 200, '.0.0/16, !10.', id % 200, '.0.5]'))[id % 4]"), F.lit("any"),
        x("CASE id % 10 WHEN 0 THEN '<-' WHEN 9 THEN '<>' ELSE '->' END"), x("if(id % 2 = 0, 'any', '$EXTERNAL_NET')"),
        x("CASE id % 3 WHEN 0 THEN cast(user_id % 60000 + 1 as string) WHEN 1 THEN concat(id % 1000 + 1, ':', id % 1000 + 21) ELSE '[80,443]' END"),
        when("id % 11 <> 0", "concat('msg:\"', event_type, ' event ', id, '\";')"), when("id % 2 = 0", "'flow:established,to_server;'"),
        x("concat('content:\"GET|20|/', id, '\";')"), when("id % 3 = 0", "'nocase;'"), when("id % 4 = 0", "concat('depth:', id % 50 + 1, ';')"), when("id % 5 = 0", "'content:\"abc\";'"),
        when("id % 7 = 0", "'pcre:\"/a.*b/i\";'"), when("id % 20 = 1", "concat('flowbits:set,f', id % 50, ';')"), when("id % 20 = 2", "concat('flowbits:isset,f', id % 60, ';')"),
        x("concat('classtype:c', id % 4, ';')"), x("concat('priority:', if(id % 97 = 0, 9, id % 4 + 1), ';')"), x("concat('reference:url,example.com/', id, ';')"),
        x("concat('metadata:k', id % 3, ' v, created ', id, ';')"), when("id % 13 <> 0", "concat('sid:', id + 1, ';')"), x("concat('rev:', id % 3 + 1, ';')"),
    )
    return e.select("id", text.alias("text"))


def rules_from_events(spark: SparkSession, sf_dir: str, errors: bool = False) -> DataFrame:
    rules = parse(texts_from_events(spark, sf_dir), "text").drop("text")
    return rules if errors else rules.where("ok")
