"""Benchmark decontamination: rare n-gram seeds, then local alignment.

1. The n-grams of all test items are counted over the whole corpus (documents that hold them). Each item
   keeps the rarer share of its n-grams as seeds, so phrases of everyday words seed nothing, and a passage
   that was copied often still does, since all of its n-grams rank alike.
2. Documents that hold a seed meet the item in a map-side join: items are read in blocks of bounded size,
   and a block travels with its tasks. Hits on nearby diagonals make one window of the text. A window that holds
   too few of the item's words for any alignment of it to count is left out: an alignment scores no more than MATCH
   for each word of the item that the window has.
3. A Smith-Waterman alignment of the item with each window (match 2, mismatch and gap -1) gives the share
   of the item's best score; ``min_score`` of it is a contamination, and so is an excerpt: an alignment over
   ``min_run`` words of the text with ``min_close`` of the best score of so many words. Edited and paraphrased
   copies keep most of it, whatever words were replaced, added or left out.

Words are lower-cased and stripped of punctuation. Items of fewer words than n seed by their whole text.
Defined results: null or wordless texts and items match nothing; a null doc_id or item_id is carried as it
is, but ``decontaminate`` keeps rows of null doc_id, since nothing names them; repeated rows give one row a pair of
ids, the first of equally good places; texts of any length are searched whole; an empty table on either side gives
no matches; extra columns of any name pass through ``decontaminate`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drop_documents, give_back, session

N, RARE, MIN_SCORE = 3, 0.75, 0.6
MIN_RUN, MIN_CLOSE = 25, 0.8
PLACES = 1 << 20
BLOCK_WORDS = 2_000_000
MATCH, OFF = 2, -1
_M = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = bytes(b for b in range(128) if not (chr(b).isalnum() or b in b" \t\n\r\x0b\x0c"))
MATCHES = "doc_id long, item_id long, score double, first_word long, last_word long"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(None, PUNCTUATION).split() if text else []


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _hashes(words: list[bytes], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams; a shorter text is one gram."""
    if not len(h):
        return h
    size = min(n, len(h))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        x = (x ^ (x >> np.uint64(29))) * _M + h[j : len(h) - size + 1 + j]
    return x


class Items:
    """A block of test items: word hashes, grams and where they stand."""

    def __init__(self, rows: list[tuple], n: int) -> None:
        known, self.n = _Hashes(), n
        self.ids = [r[0] for r in rows]
        self.words = [_hashes(words_of(r[1]), known) for r in rows]
        grams = [_grams(w, n) for w in self.words]
        self.gram = np.concatenate([*grams, np.empty(0, np.uint64)])
        self.item = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
        self.at = np.concatenate([*(np.arange(len(g)) for g in grams), np.empty(0, np.int64)]).astype(np.int64)
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        self.lengths = np.array([len(w) for w in self.words], np.int64)

    def rarest(self, of: np.ndarray, share: float) -> np.ndarray:
        """Which grams belong to their item's rarer share by frequency; ties with its last seed stay in."""
        order = np.lexsort((of, self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        last = np.minimum(sizes - 1, np.maximum(0, np.ceil(share * sizes).astype(np.int64) - 1))
        limit = np.zeros(len(self.ids), np.int64)
        has = sizes > 0
        limit[has] = of[order][(np.cumsum(sizes) - sizes + last)[has]]
        return of <= limit[self.item]

    def sort(self, keep: np.ndarray) -> None:
        order = np.argsort(self.gram[keep], kind="stable")
        self.gram, self.item, self.at = self.gram[keep][order], self.item[keep][order], self.at[keep][order]


def _occurrences(table: np.ndarray, sizes: list[int], h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places in the text, places in the sorted distinct table) of grams that the table has."""
    spots, found = [], []
    for size in sizes:
        if len(h) < size or not len(table):
            continue
        x = _grams(h, size)
        k = np.searchsorted(table, x)
        k[k == len(table)] = 0
        hit = np.flatnonzero(table[k] == x)
        spots.append(hit)
        found.append(k[hit])
    return (np.concatenate(spots), np.concatenate(found)) if spots else (np.empty(0, np.int64), np.empty(0, np.int64))


def _counter(grams: np.ndarray, sizes: list[int], n: int):
    """(gram, documents): how many of each batch's documents hold the gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams), np.int64)
        for batch in batches:
            known = _Hashes()
            for text in batch.column("text").to_pylist():
                _, found = _occurrences(grams, sizes, _hashes(words_of(text), known), n)
                if len(found):
                    total[np.unique(found)] += 1
            give_back()
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(total[k])], ["gram", "documents"])

    return run


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(score, first, last place in the text) of the best local alignment of each (item, window); all of them in step."""
    out: list = [None] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(order):
        upto, wide = at, 0
        while upto < len(order) and (upto == at or max(wide, len(pairs[order[upto]][1])) * (upto - at + 1) <= 1 << 17):
            wide = max(wide, len(pairs[order[upto]][1]))
            upto += 1
        some = order[at:upto]
        for i, found in zip(some, _align([pairs[i] for i in some], wide)):
            out[i] = found
        at = upto
    return out


def _align(pairs: list[tuple[np.ndarray, np.ndarray]], wide: int) -> list[tuple[int, int, int]]:
    c, deep = len(pairs), max(len(p[0]) for p in pairs)
    text = np.zeros((c, wide), np.uint64)
    item = np.zeros((c, deep), np.uint64)
    inside, rows = np.zeros((c, wide), bool), np.array([len(p[0]) for p in pairs])
    for i, (a, b) in enumerate(pairs):
        item[i, : len(a)], text[i, : len(b)], inside[i, : len(b)] = a, b, True
    h, start = np.zeros((c, wide + 1), np.int64), np.tile(np.arange(wide + 1), (c, 1))
    slope = np.arange(wide + 1, dtype=np.int64)
    best, last, first = np.zeros(c, np.int64), np.zeros(c, np.int64), np.zeros(c, np.int64)
    here = np.arange(c)
    for j in range(deep):
        live = rows > j
        step = np.where((text == item[:, j : j + 1]) & inside, MATCH, OFF)
        new, origin = np.zeros_like(h), np.tile(np.arange(wide + 1), (c, 1))
        for value, from_ in ((h[:, :-1] + step, start[:, :-1]), (h[:, 1:] + OFF, start[:, 1:])):
            more = value > new[:, 1:]
            new[:, 1:] = np.where(more, value, new[:, 1:])
            origin[:, 1:] = np.where(more, from_, origin[:, 1:])
        lifted = new - OFF * slope  # gaps in the item: a running maximum of what a gap costs by length
        run = np.maximum.accumulate(lifted, axis=1)
        at = np.maximum.accumulate(np.where(lifted == run, slope, 0), axis=1)
        gapped = run + OFF * slope
        origin = np.where(gapped > new, np.take_along_axis(origin, at, 1), origin)
        new = np.maximum(new, gapped)
        h, start = np.where(live[:, None], new, h), np.where(live[:, None], origin, start)
        k = h.argmax(axis=1)
        value = h[here, k]
        more = (value > best) & live
        best, last, first = np.where(more, value, best), np.where(more, k, last), np.where(more, start[here, k], first)
    return list(zip(best.tolist(), first.tolist(), (last - 1).tolist()))


def _windows(items: Items, starts: np.ndarray, ends: np.ndarray, spots: np.ndarray, found: np.ndarray, n_words: int) -> list[tuple[int, int, int]]:
    """(item, a, b): parts of the text around where hits put the items, merged where those of one item meet."""
    parts, counts = [], ends[found] - starts[found]
    upto = np.cumsum(counts)
    cuts = [0, *(np.searchsorted(upto, np.arange(PLACES, upto[-1], PLACES)) + 1).tolist(), len(found)]
    for i, j in zip(cuts, cuts[1:]):  # so many places at a time
        n = counts[i:j]
        at = np.repeat(starts[found[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item = items.item[at]
        size = items.lengths[item]
        begin, slack = np.repeat(spots[i:j], n) - items.at[at], np.maximum(8, size // 2)
        parts.append(np.unique(np.stack([item, np.maximum(0, begin - slack), np.minimum(n_words, begin + size + slack)]), axis=1))
    item, a, b = np.unique(np.concatenate(parts, axis=1), axis=1)  # by item, then place: windows of one item are equally long, so their ends rise too
    first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (a[1:] > b[:-1])])
    last = np.r_[first[1:], len(item)] - 1
    return list(zip(item[first].tolist(), a[first].tolist(), b[last].tolist()))


def _matcher(items: Items, min_score: float, min_run: int, min_close: float):
    starts = np.flatnonzero(np.r_[True, items.gram[1:] != items.gram[:-1]]) if len(items.gram) else np.empty(0, np.int64)
    table, ends = items.gram[starts], np.r_[starts[1:], len(items.gram)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, todo, pairs = _Hashes(), [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                h = _hashes(words_of(text), known)
                spots, found = _occurrences(table, items.sizes, h, items.n)
                if not len(spots):
                    continue
                for i, a, b in _windows(items, starts, ends, spots, found, len(h)):
                    item = items.words[i]
                    if np.isin(item, h[a:b]).sum() >= min(min_score * len(item), min_close * min_run):
                        todo.append((doc, i, a))
                        pairs.append((item, h[a:b]))
            best: dict = {}
            for (doc, i, a), (score, first, last) in zip(todo, align(pairs)):
                share, span = score / (MATCH * len(items.words[i])), last - first + 1
                counts = share >= min_score or span >= min_run and score >= min_close * MATCH * span
                if counts and share > best.get((doc, i), (0,))[0]:
                    best[doc, i] = (share, a + first, a + last)
            del todo, pairs, known
            give_back()
            rows = [(d, items.ids[i], *v) for (d, i), v in best.items()]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds)], [x.split()[0] for x in MATCHES.split(", ")])

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple]]:
    rows, held = [], 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        rows.append((r[0], r[1]))
        held += len(r[1].split())
        if held >= block_words:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def matches(
    docs: DataFrame, benchmark: DataFrame, n: int = N, rare: float = RARE, min_score: float = MIN_SCORE, min_run: int = MIN_RUN, min_close: float = MIN_CLOSE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """doc_id, item_id, score and the words first_word to last_word of each contaminated pair."""
    spark = session(docs)
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], MATCHES)
    for rows in _blocks(benchmark, block_words):
        items = Items(rows, n)
        grams = np.unique(items.gram)
        counted = texts.select("text").mapInArrow(_counter(grams, items.sizes, n), "gram long, documents long")
        totals = counted.groupBy("gram").agg(F.sum("documents").alias("documents")).collect()  # at most the block's grams
        frequency = np.zeros(len(grams), np.int64)
        for r in totals:
            frequency[r["gram"]] = r["documents"]
        of = frequency[np.searchsorted(grams, items.gram)]
        items.sort(items.rarest(of, rare))
        out = out.unionByName(texts.mapInArrow(_matcher(items, min_score, min_run, min_close), MATCHES))
    best = out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"))).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, the columns as they are."""
    return drop_documents(docs, matches(docs, benchmark, **options))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated pairs over all documents and all items."""
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
