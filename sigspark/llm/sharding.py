"""Contiguous shards of near-equal bytes, from a global prefix sum of document sizes.

Only (doc_id, size, crc32) moves, never a text. Documents are dealt by ranges of doc_id; each partition is
summed by itself, the running totals of the partitions (a row each) give its offset, and the two together
are the global prefix sum. A document belongs to the shard in which the middle of its bytes falls when the
total is cut at equal targets, so shards are contiguous in doc_id order and differ from the target by less
than one document at either end. This law balances bytes; it does not keep equal texts together.

Defined results: a null text has no bytes and size 1; a null doc_id sorts first; repeated rows are each
placed, next to one another; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, session

ORDER = ("doc_id", "text_crc32", "size")


def shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    spark = session(docs)
    rows = docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumns({"_upto": F.sum("size").over(inside), "_row": F.count(F.lit(1)).over(inside)})
    placed = placed.join(F.broadcast(offsets), "part")  # as many rows as partitions
    middle = F.expr("2 * (bytes_before + _upto) - size")  # twice the middle byte
    placed = placed.select(
        *ORDER,
        F.least(F.floor(F.expr(f"{n_shards}L") * middle / (2 * F.col("total"))), F.lit(n_shards - 1)).cast("int").alias("shard"),
        (F.col("n_before") + F.col("_row") - 1).alias("_at"),
    )
    placed = cut(placed)
    first = placed.groupBy("shard").agg(F.min("_at").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _crc_table() -> list[int]:
    """The table of CRC-32 by its polynomial."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def oracle(n_shards: int = 8) -> str:
    """DuckDB SQL for shards over documents; DuckDB has no CRC-32, so it folds the bytes over the table."""
    step = "xor(s >> 8, crc[(xor(s, v) & 255) + 1])"
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), t AS (SELECT {_crc_table()}::BIGINT[] AS crc),
c AS (SELECT doc_id, len(x) // 2 + 1 AS size, CASE WHEN x = '' THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(x, '..'), lambda h: ('0x' || h)::BIGINT)), lambda s, v: {step}), 4294967295) END AS text_crc32 FROM d, t),
s AS (SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, least({n_shards} * (2 * upto - size) // (2 * total), {n_shards - 1})::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INT AS grown_shard FROM p"""


ORACLE_SQL = oracle()
