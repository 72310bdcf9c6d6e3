"""A training-corpus pipeline: five stages over documents, each a step of the operators in sigspark.llm.

Each stage gets what its predecessor kept, and all but the last return the columns of documents.

Defined results: a null or empty text fails the quality rules, as does one of under 20 words; of equal rows one stays
(near dedup); rows of a null doc_id that pass the quality rules stay to the end, since nothing names them; ties are
broken by the smallest doc_id; an empty table gives an empty result with the same columns; further columns of
documents, whatever their names, pass through the first four stages untouched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sigspark.functions.lineage import remove, shared_dir
from sigspark.llm.decontaminate import decontaminate
from sigspark.llm.line_dedup import line_dedup
from sigspark.llm.near_dedup import near_dedup
from sigspark.llm.piece_codec import encode
from sigspark.llm.quality_rules import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the ids of the text, their number and whether they decode to it."""
    out = encode(docs)
    return out.select("doc_id", "lang", "source", "_piece.n_tokens", "_piece.n_bytes_fallback", "_piece.lossless", "_piece.ids")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("piece encoding", pieces)]

#: Hash sketches, alignments and Viterbi paths have no SQL; a test holds the rows of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder as Parquet and read again; only the last one's folder stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
