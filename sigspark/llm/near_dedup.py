"""MinHash near-duplicate removal with sequential Bayesian verification.

1. Every text becomes its set of distinct k-word shingles (A-Z lower-cased; with fewer than k words, the
   whole sequence is one shingle). One pass computes a 128-bit digest of the set, 252 minima of random
   hashes in 36 bands of 7, and one bit of each of 256 minima. Rows of one set and one text (by 64 bits of the
   digest and 64 of the text) are one node; different texts of one set share all bands and are compared like others.
2. Nodes that share a band are candidates. Bands of at most 32 members are joined; the pairs are
   pruned by comparing the signature in batches of 64 bits: after each batch a pair is dropped when the
   posterior probability (uniform prior) that its similarity reaches the threshold is below ``miss``.
   A larger band only states that its members belong to one cell (a star to its smallest member; the stars of a
   node are joined at the least centre, so a large group has about one edge a member, not one a band).
3. Cells (components of what survived) of one block are verified in one task: all signatures are compared,
   batch by batch, and then the surviving pairs on their full shingle sets, unless links found before
   connect them already. In a cell of more blocks, each member is first verified against one partner (the
   centre of its star), centres with as many tasks as they need. What that connects best, the cell's main
   component, need not be compared within itself: only the rest of the cell meets it and each other, every pair
   of blocks in a task of its own. So a group of n copies never becomes n * n rows, no group meets in
   one task, and the texts of a large group of alike documents travel once or twice.
4. Components over links give every document the smallest doc_id that it can reach. Here as above, tasks make their
   edges stars first, and rounds of large and small stars join those of more tasks than one.

Defined results: a null or wordless text has no shingles and links with nothing; a null doc_id keeps its
row with a null component; rows of one doc_id and different texts are documents of their own; equal rows
belong to one component, of which ``near_dedup`` keeps one row (the smallest doc_id, then the smallest hash of
the text); an empty table gives an empty result; extra columns of any name pass through ``near_dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, connected_components, cut, give_back, join_checked, join_hot, session, unused

BANDS, ROWS, BITS = 36, 7, 256
BATCHES = BITS // 64
SMALL_BAND = 32
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 500_000
_SLICE = 1 << 15
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, 2 * BITS + 1, dtype=np.uint64)
    r = _mix(i * _M)
    return r[:BITS] | np.uint64(1), r[BITS:]


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII letters and white space only, as wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _set_hashes(words: list[bytes], k: int, known: _Hashes) -> np.ndarray:
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    size = min(k, n)
    x = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        x = _mix(x * _M + h[j : n - size + 1 + j])
    return np.unique(x)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        weights = _mix(np.arange(1, ROWS + 1, dtype=np.uint64) * _M) | np.uint64(1)
        for batch in batches:
            known = _Hashes()
            sets = [_set_hashes(words_of(t), k, known) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            d1, d2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            mins = np.zeros((BITS, len(sets)), np.uint64)
            full = np.flatnonzero(sizes)
            at = 0
            while at < len(full):  # so many sets as fit into a CPU's cache
                upto, total = at, 0
                while upto < len(full) and (upto == at or total + sizes[full[upto]] <= _SLICE):
                    total += sizes[full[upto]]
                    upto += 1
                who = full[at:upto]
                x = np.concatenate([sets[i] for i in who])
                starts = np.concatenate([[0], np.cumsum(sizes[who])[:-1]])
                d1[who] = np.add.reduceat(_mix(x), starts)
                d2[who] = np.add.reduceat(_mix(x ^ _M), starts)
                y = np.empty_like(x)
                for i in range(BITS):
                    np.bitwise_xor(x, b[i], out=y)
                    np.multiply(y, a[i], out=y)
                    mins[i, who] = np.minimum.reduceat(y, starts)
                at = upto
            bits = ((mins >> np.uint64(20)) & np.uint64(1)).astype(np.uint8)
            packed = np.ascontiguousarray(np.packbits(bits, axis=0).T).view(np.int64)
            rows = mins[: BANDS * ROWS].reshape(BANDS, ROWS, -1)
            keys = np.arange(BANDS, dtype=np.uint64)[:, None] * _M
            for j in range(ROWS):
                keys = _mix(keys + rows[:, j] * weights[j])
            offsets = lambda n: pa.array(np.arange(len(sets) + 1, dtype=np.int32) * n)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("h"),
                    pa.array(sizes),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.ListArray.from_arrays(offsets(BANDS), pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())),
                    pa.ListArray.from_arrays(offsets(BATCHES), pa.array(packed.ravel())),
                ],
                ["doc_id", "h", "n_shingles", "d1", "d2", "bands", "sketch"],
            )
            del sets, mins, rows, keys, known
            give_back()

    return run


def least_matches(threshold: float, miss: float, grid: int = 2000) -> list[int]:
    """For each batch, the fewest equal bits so far with which a pair may still reach the threshold.

    A bit of two sets of similarity s is equal with probability (1 + s) / 2. With a uniform prior on s,
    the posterior P(s >= threshold | m of n bits equal) grows with m; below ``miss`` the pair goes.
    """
    out = []
    s = (np.arange(grid) + 0.5) / grid
    p = (1 + s) / 2
    for batch in range(1, BATCHES + 1):
        n = 64 * batch
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                out.append(m)
                break
    return out


class _Links:
    """Union-find."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.up[self.find(i)] = self.find(j)


def _verify(rows: list[tuple], k: int, percent: int, least: list[int]) -> list[tuple[int, int]]:
    """Links that span the components of these rows: (rep, block is the second, n_shingles, sketch, text)."""
    n = len(rows)
    second = np.array([r[1] for r in rows], bool)
    sizes = np.array([r[2] for r in rows], np.int64)
    sketch = np.array([r[3] for r in rows], np.int64).view(np.uint64).reshape(n, BATCHES)
    mixed = bool(second.any()) and not second.all()
    ids: dict[bytes, int] = {}
    sets: dict[int, set] = {}

    def whole(i: int) -> set:
        if i not in sets:
            w = [ids.setdefault(x, len(ids)) for x in words_of(rows[i][4])]
            size = min(k, len(w))
            packed = w[: len(w) - size + 1]
            for j in range(1, size):
                packed = [(a << 32) | b for a, b in zip(packed, w[j:])]
            sets[i] = set(packed)
        return sets[i]

    found, links = _Links(n), []
    order = np.argsort(sizes, kind="stable")  # neighbours in size come first, and a set's range of sizes is a run
    ranked = sizes[order]
    for at in range(n - 1):
        i = order[at]
        upto = np.searchsorted(ranked, ranked[at] * 100 // percent, side="right")
        others = order[at + 1 : upto]
        if mixed:
            others = others[second[others] != second[i]]
        same = np.zeros(len(others), np.int64)
        for batch in range(BATCHES):
            same = same + (64 - np.bitwise_count(sketch[others, batch] ^ sketch[i, batch]).astype(np.int64))
            stay = same >= least[batch]
            others, same = others[stay], same[stay]
            if not len(others):
                break
        for j in others[np.argsort(-same, kind="stable")]:
            if found.find(i) != found.find(j):
                a, b = whole(i), whole(j)
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    found.join(i, j)
                    links.append((rows[i][0], rows[j][0]))
    return links


def _verifier(k: int, percent: int, least: list[int]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows, links = None, [], []
        for frame in frames:
            for cell, bi, bj, block, rep, n, sketch, text in frame.itertuples(index=False):
                if (cell, bi, bj) != key:
                    links += _verify(rows, k, percent, least) if len(rows) > 1 else []
                    key, rows = (cell, bi, bj), []
                if not rows or rows[-1][0] != rep:  # rows are sorted by rep; equal rows of the table stand for one
                    rows.append((rep, block == bj and bi != bj, n, sketch, text))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])
                links = []
            give_back()
        links += _verify(rows, k, percent, least) if len(rows) > 1 else []
        yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _dealt(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Rows for the verifier: every member (node, doc, h, tasks: array of (cell, bi, bj, block)) with its text in each of its tasks."""
    found = join_checked(texts, members.withColumnRenamed("doc", "doc_id"), ["doc_id", "h"], "inner", rows=500_000, salt=False)
    rows = found.select(F.explode("tasks").alias("t"), F.col("node").alias("rep"), "n_shingles", "sketch", "text")
    rows = rows.select("t.cell", "t.bi", "t.bj", "t.block", "rep", "n_shingles", "sketch", "text")
    return rows.repartition("cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj", "block", "rep")


TASK = "named_struct('cell', {cell}, 'bi', cast({bi} as int), 'bj', cast({bj} as int), 'block', cast({block} as int))"


def _first_links(texts: DataFrame, edges: DataFrame, members: DataFrame, verifier) -> DataFrame:
    """Verified links of the members with one partner each: the smallest that an edge (a, b) names."""
    known = members.select("node", "doc", "h", "n_shingles", "sketch")
    partner = edges.join(known.select(F.col("node").alias("a")), "a").groupBy("a").agg(F.min("b").alias("b"))
    leaves = cut(partner)
    centres = leaves.groupBy("b").agg(F.expr(f"cast(ceil(count(1) / {BLOCK_DOCS}) as int)").alias("parts"), F.count(F.lit(1)).alias("n"))
    dealt = join_hot(leaves, centres, ["b"], "n", leaves.count()).withColumn("part", F.expr("cast(pmod(xxhash64(a), parts) as int)"))
    leaf = dealt.select(F.col("a").alias("node"), F.expr("array(" + TASK.format(cell="b", bi="part", bj=-1, block="part") + ")").alias("tasks"))
    centre = centres.select(F.col("b").alias("node"), F.expr("transform(sequence(0, parts - 1), p -> " + TASK.format(cell="b", bi="p", bj=-1, block=-1) + ")").alias("tasks"))
    both = cut(known.join(leaf.unionByName(centre), "node"))
    return cut(_dealt(texts, both).mapInPandas(verifier, "a long, b long"))


def _verified(docs: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """doc_id, h, n_shingles, component_id and keeper (whether the row's text is the one that stays of its component) of every row."""
    spark = session(docs)
    bounded_batches(spark)
    least = least_matches(percent / 100, miss)
    verifier = _verifier(k, percent, least)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    schema = "doc_id long, h long, n_shingles long, d1 long, d2 long, bands array<long>, sketch array<long>"
    signed = cut(texts.mapInArrow(_signatures(k), schema))
    has = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    sets = signed.where(has).groupBy("d1", "h")
    nodes = sets.agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sketch")).alias("r"), F.count(F.lit(1)).alias("copies"))
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "d1", "h", F.col("r.doc_id").alias("doc"), "r.n_shingles", "r.bands", "r.sketch", "copies"))

    count = nodes.count()
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).where("n > 1").withColumn("members", F.col("n"))
    rows = cut(join_hot(banded, shared, ["band"], "n", BANDS * count))
    few = rows.where(f"members <= {SMALL_BAND}").select("band", "node")
    pairs = few.alias("x").join(few.alias("y"), "band").where("x.node < y.node").select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    upto = "0"
    for batch, m in enumerate(least):  # a batch is looked at only if those before it have not pruned the pair
        upto += f" + 64 - bit_count(sa[{batch}] ^ sb[{batch}])"
        pairs = pairs.where(f"{upto} >= {m}")
    centres = rows.where(f"members > {SMALL_BAND}").groupBy("node").agg(F.collect_set("first").alias("c")).withColumn("b", F.array_min("c"))  # at most one a band
    stars = centres.select(F.explode(F.array_union("c", F.array("node"))).alias("a"), "b").where("a <> b")  # a node to its least centre, its others to that
    edges = cut(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")).unionByName(stars.distinct()))
    cells = connected_components(edges, native=False)

    sized = cells.select("node", F.col("component").alias("cell")).join(nodes.select("node", "doc", "h", "n_shingles", "sketch"), "node")
    blocks = sized.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.expr(f"cast(ceil(greatest(count(1) / {BLOCK_DOCS}, sum(n_shingles) / {BLOCK_SHINGLES})) as int)").alias("blocks"))
    members = cut(join_hot(sized, blocks, ["cell"], "n", count))
    alone = members.where("blocks = 1").withColumn("tasks", F.expr("array(" + TASK.format(cell="cell", bi=0, bj=0, block=0) + ")")).drop("blocks")
    links = cut(_dealt(texts, alone).mapInPandas(verifier, "a long, b long"))
    large = members.where("blocks > 1")
    if not large.isEmpty():
        first = _first_links(texts, edges, large, verifier)
        joined = connected_components(first, native=False)
        labelled = large.join(joined, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
        counts = cut(labelled.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles")))
        needs = lambda c, n, s: F.expr(f"cast(ceil(greatest({n} / {BLOCK_DOCS}, {s} / {BLOCK_SHINGLES})) as int)").alias(c)
        whole = counts.groupBy("cell").agg(F.sum("n").alias("rows"), F.sum("shingles").alias("s"), F.max(F.struct("n", "part", "shingles")).alias("m"))
        whole = whole.select("cell", F.col("m.part").alias("main"), "rows", needs("r", "(rows - m.n)", "(s - m.shingles)"), needs("q", "m.n", "m.shingles"))
        rest = join_hot(cut(labelled), whole.where("r > 0"), ["cell"], "rows", count).withColumn("i", F.expr("cast(if(part = main, r + pmod(xxhash64(node), q), pmod(xxhash64(node), r)) as int)"))
        tasks = "transform(sequence(0, if(i >= r, r, r + q) - 1), j -> " + TASK.format(cell="cell", bi="least(i, j)", bj="greatest(i, j)", block="i") + ")"
        more = _dealt(texts, cut(rest.select("node", "doc", "h", "n_shingles", "sketch", F.expr(tasks).alias("tasks")))).mapInPandas(verifier, "a long, b long")
        links = links.unionByName(first).unionByName(cut(more))
    joined = cut(connected_components(links, native=False))

    label = nodes.select("node", "d1", "h", "doc", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least_doc = label.groupBy("component").agg(F.min(F.struct("doc", "h", "d1")).alias("least"), F.count(F.lit(1)).alias("n"))
    label = join_hot(label, least_doc, ["component"], "n", count)
    label = cut(label.select("d1", "h", "copies", F.col("least.doc").alias("component_id"), (F.struct("doc", "h", "d1") == F.col("least")).alias("keeper")))
    found = join_hot(signed.where(has).select("doc_id", "h", "n_shingles", "d1"), label, ["d1", "h"], "copies", signed.count())
    found = found.withColumn("keeper", F.col("keeper") & (F.col("doc_id") == F.col("component_id")))
    bare = signed.where(~has).select("doc_id", "h", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper"))
    return found.select(*bare.columns).unionByName(bare)


def components(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs; similarity at least percent / 100."""
    out = _verified(docs, k, percent, miss)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-7) -> DataFrame:
    """docs with one row of each component, the columns as they are."""
    verdicts = cut(_verified(docs, k, percent, miss).where("doc_id is not null").select("doc_id", "h", "keeper"))
    h = unused(docs, "_h")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    named = lambda df: cut(df.select("doc_id", F.col("h").alias(h)).distinct())
    kept = join_checked(keyed, named(verdicts.where("not keeper")), ["doc_id", h], "left_anti", salt=False)
    twice = named(verdicts.groupBy("doc_id", "h").count().where("count > 1"))
    if not twice.isEmpty():
        rest = join_checked(kept, twice, ["doc_id", h], "left_anti", salt=False)
        kept = rest.unionByName(join_checked(kept, twice, ["doc_id", h], "left_semi", salt=False).dropDuplicates(["doc_id", h]))
    return kept.select(*docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


#: DuckDB SQL for op2: every pair that shares a shingle is compared, and closed over by recursion.
ORACLE_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""
