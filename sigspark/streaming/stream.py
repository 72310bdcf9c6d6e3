"""Structured Streaming over folders of rule files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import parse
from ..operators.pipeline import Processor


def stream_rules(spark: SparkSession, folder: str, dialect: str = "suricata", files_per_batch: int = 100) -> DataFrame:
    """Rules of the files that appear in a folder, a line each."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse(lines.where("trim(value) <> '' and not trim(value) like '#%'"), "value", dialect=dialect).drop("value")


def run_batches(
    rules: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, steps: Processor | None = None, progress: Callable[[int, int, int], None] | None = None
) -> StreamingQuery:
    """Hands every micro-batch, processed, to sink(df, batch_id); restarts where the checkpoint ends. progress gets the batch, its rules and its errors."""

    def each(df: DataFrame, i: int) -> None:
        sink(steps(df) if steps else df, i)
        if progress:
            good, bad = df.agg(F.count_if("ok"), F.count_if(~F.col("ok"))).first()
            progress(i, good, bad)

    return rules.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(rules: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys as a streaming aggregation: complete or update mode."""
    return rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("rules"), F.count_if(~F.col("ok")).alias("errors"))
