"""Helpers shared by the training-data operators: lineage cuts, size-checked joins, components."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, shared_dir

__all__ = [
    "TwoAges", "bounded_batches", "connected_components", "cut", "drop_documents", "give_back", "join_checked", "join_hot", "let", "release", "session", "shared_dir", "small", "unused", "worker_cache",
]

#: Largest number of narrow rows (a few longs each) that a join may broadcast.
BROADCAST_ROWS = 1_000_000
#: Largest number of bytes of strings that a join may broadcast.
BROADCAST_BYTES = 32 << 20
#: How many ways a key is split when a side is too large to broadcast.
SALTS = 16
#: Rows of two numbers that a task of an iterative step takes.
ROWS_A_TASK = 100_000


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes as well as rows, so that long texts cannot fill a worker; smaller bounds of the session stay."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        found = spark.conf.get(key, None)
        if not (found and found.isdigit() and 0 < int(found) <= value):
            spark.conf.set(key, str(value))


def give_back() -> None:
    """Returns what this Python worker has freed to the machine; a worker lives through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, over all tasks it runs."""
    name = "_llm_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
    return sys.modules[name].__dict__


class TwoAges(dict):
    """A dictionary of bounded size: past the bound it becomes the old one, whose entries return when they are asked for."""

    def __init__(self, bound: int) -> None:
        super().__init__()
        self.bound, self.old = bound, {}

    def missing(self, keys: set) -> list:
        """The distinct keys that neither age has; those of the old age are taken over first."""
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        out = []
        for k in keys.difference(self):
            v = self.old.get(k)
            if v is None:
                out.append(k)
            else:
                self[k] = v
        return out


def let(df: DataFrame, **values: Column) -> DataFrame:
    """Adds columns behind a Generate node: the optimizer cannot copy their expressions into lambdas."""
    packed = F.struct(*[v.alias(k) for k, v in values.items()])
    return df.select("*", F.inline(F.array(packed)))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> bool:
    """Whether a (checkpointed) table is within the broadcast bound, by count and by bytes, size giving those of a row."""
    size = F.lit(0) if size is None else F.sum(size)
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return n <= rows and total <= BROADCAST_BYTES


def join_checked(
    left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS, size: Column | None = None, salt: bool = True
) -> DataFrame:
    """Joins a large left with a lookup table that has one row a key.

    The lookup is broadcast only if it is counted and within bounds. Beyond them, each lookup row is
    repeated SALTS times and the left rows are dealt over the salts by a hash of their other columns, so a
    hot key is spread, and a task that runs again deals its rows as before.
    """
    if small(right, rows, size):
        return left.join(F.broadcast(right), on, how)
    if not salt:
        return left.join(right, on, how)
    spread = right.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    other = [f.name for f in left.schema.fields if f.name not in on and "map<" not in f.dataType.simpleString()]
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*other, F.lit(0)), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int) -> DataFrame:
    """Inner join of left with a table that has one row a key and, in ``rows``, how many rows of left hold it (total in all).

    Keys of more than 1,000 rows and of more than a 100,000th of all are met by a broadcast, which no more than
    100,000 rows of right can reach, so left's rows of a hot key stay where they are; the others are shuffled.
    """
    bound = max(1000, total // 100_000)
    values = [c for c in right.columns if c not in (*on, rows)]
    hot = right.where(F.col(rows) > bound).select(*on, F.struct(F.lit(True).alias("_"), *values).alias("_hot"))
    marked = left.join(F.broadcast(hot), on, "left")
    cold = marked.where("_hot is null").drop("_hot").join(right.where(F.col(rows) <= bound).select(*on, *values), on)
    return cold.unionByName(marked.where("_hot is not null").select(*left.columns, *[F.col(f"_hot.{c}").alias(c) for c in values]))


def release(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars: each of its nodes with the smallest that it reaches by them, both long."""
    up: dict[int, int] = {}
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for i in (x, y):
                up.setdefault(i, i)
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            up[max(x, y)] = min(x, y)  # so that a root is the smallest of its tree
    for i in sorted(up):
        up[i] = up[up[i]]  # those above are smaller and so have their root by now
    leaves = [i for i, root in up.items() if i != root]
    u, v = pa.array(leaves, pa.int64()), pa.array([up[i] for i in leaves], pa.int64())
    up.clear()
    del leaves
    yield from pa.Table.from_arrays([u, v], ["u", "v"]).to_batches(max_chunksize=10_000)
    give_back()


def connected_components(edges: DataFrame, max_rounds: int = 200, native: bool = True) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star steps.

    edges has two columns of one orderable type. Returns (node, component): every node of an edge
    between different nodes, and the smallest node that it reaches. Null ends and loops are left out.
    Each step is a partial minimum and a join, its output no larger than the edges, and the neighbours of
    a hub are not brought into one task; every round is written to the shared folder. Labels never come
    to the driver, which sees a count and a checksum. The number of rounds grows with the logarithm of the
    longest path; without a fixed point after max_rounds, it fails rather than return half a result.

    Every round leaves jobs, plans and tasks in the driver's memory. Unless native, edges (of longs, computed before) are
    first made stars within tasks of ROWS_A_TASK edges; a graph that fits one task is then done, without a round.
    """
    a, b = edges.columns[:2]
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    if not native:
        few = 1 + e.count() // ROWS_A_TASK
        bounded_batches(session(edges))
        e = cut(e.coalesce(few).mapInArrow(_stars, "u long, v long"))
        release(session(edges))
    if native or few > 1:
        e = _rounds(e, max_rounds)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    """(u, v) of the graph of edges (u, v): every node u with the smallest v that it reaches."""
    e = cut(edges.distinct())
    seen = None
    for turn in range(max_rounds):
        if turn % 3 == 2:
            release(session(edges))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return e
        seen = state
        few = 1 + state[0] // ROWS_A_TASK  # small graphs need no more tasks, and leave no more files, than these
        few_e = e.coalesce(few)
        both = few_e.unionByName(few_e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = join_hot(both, low, ["u"], "n", 2 * state[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(few)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small_star = join_hot(large, low, ["u"], "n", 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small_star.unionByName(low.select("u", F.col("m").alias("v"))).distinct().coalesce(few))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def drop_documents(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids of gone; docs keeps its partitions when gone is small. A null doc_id names no row, so rows of null doc_id stay."""
    gone = cut(gone.select("doc_id").where("doc_id is not null").distinct())
    return join_checked(docs, gone, ["doc_id"], "left_anti", salt=False)
