"""Token-id files: one zstandard frame a document, a dictionary shared by all, and an offset index.

Texts are encoded with a public tokenizer; an end id closes each document. A zstandard dictionary is trained
once, on the serialized ids of a bounded sample (``sample_docs`` documents of the smallest hashes of doc_id,
texts over ``sample_chars`` characters left out); every document of the table is then compressed by itself
with it. Rows are dealt by ranges of doc_id (and a hash of the text, which parts the rows of a doc_id that many
share) and sorted before they are encoded, so a task streams its part into blocks of about ``block_bytes``. The
number of ids before a block is the sum of the parts before its own, and of the blocks before it in its part. A block is

    magic b"TOKD1\\0\\0\\0", dictionary hash u64, n u64, doc_ids n * i64, null flags n * u8,
    ids n * u32 (number of ids), offsets (n + 1) * u64 (from the first frame), frames

in little-endian order: one document is read by its offset and the dictionary alone. Blocks are rows of a
Parquet table next to the dictionary, written by Spark's committers, so a lost executor leaves no half files
and any store that Spark can reach will do. The hash in each block names its dictionary.

White space separates the tokenizer's input and letters separate from punctuation before any merge, so the ids
of words join to those of the text: each distinct run of letters is encoded once per worker, the rest is Arrow.

Defined results: a null text is an empty document of the end id alone; a null doc_id sorts first; repeated
rows are stored next to one another; an empty table gives no blocks; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoAges, bounded_batches, cut, join_checked, session, shared_dir, worker_cache

MAGIC = b"TOKD1\0\0\0"
END_ID = 2
KNOWN_WORDS = 250_000
DICT_BYTES = 112_640
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
#: letters and then signs, for RE2: the tokenizer parts the two whatever they are
PLAIN = rf"^(?P<letters>{LETTER}+)(?P<signs>[^\sA-Za-z0-9'<\x80-\x{{10ffff}}]*)$"
LETTERS = re.compile(f"{LETTER}+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts as little-endian u32 bytes, from the tokenizer's ids of their words."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cores = TwoAges(KNOWN_WORDS)

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if LETTERS.fullmatch(x)]
        for at in range(0, len(plain), 1024):  # each is one pre-token, so its last id ends a word and no other does
            some = plain[at : at + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the ends of words")
            data, bounds = ids.tobytes(), [0, *(ends * 4).tolist()]
            self.cores.update(zip(some, (data[a:b] for a, b in zip(bounds, bounds[1:]))))
        odd = [x for x in new if x not in self.cores]
        for x, e in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.cores[x] = np.array(e.ids, "<u4").tobytes()

    def _look_up(self, cores: pa.Array) -> pa.Array:
        coded = cores.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self._learn(self.cores.missing(set(distinct)))
        return pa.array(map(self.cores.__getitem__, distinct), pa.large_binary(), size=len(distinct)).take(coded.indices)

    def encode_batch(self, texts: pa.Array) -> list[bytes]:
        """Arrow splits at ASCII white space and codes the words; Python sees the distinct cores of a batch alone."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        parts = pc.extract_regex(words, PLAIN)
        letters, signs = parts.flatten()
        cores = pc.if_else(parts.is_valid(), pc.utf8_lower(letters), words)
        ids = pc.binary_join_element_wise(self._look_up(cores), self._look_up(signs.fill_null("")), pa.scalar(b"", pa.large_binary())).take(coded.indices)
        if not len(ids):
            return [b""] * len(texts)
        firsts = split.offsets.to_numpy()
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1, 8 * ids.offset)[firsts - firsts[0]].tolist()
        whole = memoryview(data or b"")
        return [bytes(whole[a:b]) for a, b in zip(ends, ends[1:])]


def _encoder(model: str, end_id: int, shared):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache, key = worker_cache(), f"words {hashlib.sha256(model.encode()).hexdigest()}"
        words = cache[key] = cache.get(key) or WordEncoder(model)
        press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared), level=3) if shared is not None else None
        for batch in batches:
            ids = [x + end for x in words.encode_batch(batch.column("text"))]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            frames = pa.array([press.compress(x) if press else x for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), counts, frames], ["doc_id", "n_tokens", "frame"])

    return run


ENCODED = "doc_id long, n_tokens long, frame binary"


def train_dictionary(docs: DataFrame, model: str, end_id: int = END_ID, sample_docs: int = 1500, sample_chars: int = 20_000) -> bytes:
    """The bytes of a zstandard dictionary; from too few documents, a raw one of their ids."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.length("text") <= sample_chars)).distinct()
    chosen = [r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()]
    some = docs.select("doc_id", "text").where(F.col("doc_id").isin(chosen) & (F.length("text") <= sample_chars))
    samples = [bytes(r[0]) for r in some.coalesce(8).mapInArrow(_encoder(model, end_id, None), ENCODED).select("frame").limit(2 * sample_docs).collect()]
    samples = sorted(samples)
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:] or b"\0" * 8


def dictionary_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little")


def pack(rows: list[tuple], dict_hash: int) -> bytes:
    """The bytes of a block of (doc_id, n_tokens, frame)."""
    frames = [r[2] for r in rows]
    return b"".join(
        [
            MAGIC,
            np.array([dict_hash, len(rows)], "<u8").tobytes(),
            np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
            np.array([r[0] is None for r in rows], "u1").tobytes(),
            np.array([r[1] for r in rows], "<u4").tobytes(),
            np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<u8").tobytes(),
            *frames,
        ]
    )


class Block:
    """Reads a block: the index at once, a document when asked for."""

    def __init__(self, data: bytes, dictionary: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token block")
        known, n = np.frombuffer(data, "<u8", 2, 8)
        if int(known) != dictionary_hash(dictionary):
            raise ValueError("the block was written with another dictionary")
        n = int(n)
        self.doc_ids = np.frombuffer(data, "<i8", n, 24)
        self.null = np.frombuffer(data, "u1", n, 24 + 8 * n).astype(bool)
        self.counts = np.frombuffer(data, "<u4", n, 24 + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, 24 + 13 * n)
        self.at, self.data = 24 + 13 * n + 8 * (n + 1), data
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))

    def raw(self, i: int) -> bytes:
        return self.reader.decompress(self.data[self.at + int(self.offsets[i]) : self.at + int(self.offsets[i + 1])])

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), "<u4")


def _packer(encode, dict_hash: int, block_bytes: int):
    """Batches of (doc_id, text) of a partition, in order, to its blocks; part is the partition's place among all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, rows, held = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            known = [r[0] for r in rows if r[0] is not None]
            row = [part, seq, len(rows), sum(r[1] for r in rows), min(known, default=None), max(known, default=None), pack(rows, dict_hash)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], BLOCKS.names)

        for batch in encode(batches):
            for d, n, f in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "frame"))):
                if rows and held + len(f) > block_bytes:
                    yield block()
                    seq, rows, held = seq + 1, [], 0
                rows.append((d, n, f))
                held += len(f)
        if rows:
            yield block()

    return run


BLOCKS = T.StructType(
    [T.StructField(x, T.IntegerType()) for x in ("part", "seq")] + [T.StructField(x, T.LongType()) for x in ("n_docs", "n_tokens", "first_doc_id", "last_doc_id")] + [T.StructField("data", T.BinaryType())]
)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_bytes: int = 2 << 20) -> None:
    """Writes path/dictionary and path/blocks."""
    spark = session(docs)
    bounded_batches(spark)
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as f:
        model = f.read()
    dictionary = train_dictionary(docs, model, end_id)
    key = dictionary_hash(dictionary)
    spark.createDataFrame([(key - (1 << 64) if key >= 1 << 63 else key, bytearray(dictionary))], "hash long, data binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]  # the hash parts the rows of a doc_id that many share
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInArrow(_packer(_encoder(model, end_id, dictionary), key, block_bytes), BLOCKS).write.parquet(f"{path}/blocks")


def _dictionary(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["data"])


def _reader(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist()):
                b = Block(data, dictionary)
                n = len(b.counts)
                starts = start + np.concatenate([[0], np.cumsum(b.counts.astype(np.int64))[:-1]])
                crc = pa.array([zlib.crc32(b.raw(i)) for i in range(n)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids, mask=b.null), pa.array(starts), pa.array(b.counts.astype(np.int64)), crc, pa.array(np.diff(b.offsets).astype(np.int64))],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "n_bytes"],
                )

    return run


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it), n_tokens, ids_crc32 and n_bytes (of its frame) of every document, from the files."""
    bounded_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each partition that was written
    totals = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("start")).join(F.broadcast(totals), "part")
    starts = cut(starts.select("part", "seq", (F.col("start") + F.col("first")).alias("start")))
    rows = join_checked(blocks.select("part", "seq", "data"), starts, ["part", "seq"], "inner", rows=300_000, salt=False)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, n_bytes long"
    return rows.select("start", "data").mapInArrow(_reader(_dictionary(spark, path)), schema)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents with this id: only blocks whose range holds it are read, only its frames decompressed."""
    dictionary = _dictionary(spark, path)
    rows = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").where((F.col("first_doc_id") <= doc_id) & (F.col("last_doc_id") >= doc_id)).orderBy("part", "seq")
    out = []
    for row in rows.select("data").toLocalIterator():
        b = Block(bytes(row[0]), dictionary)
        out += [b.ids(int(i)).tolist() for i in np.flatnonzero((b.doc_ids == doc_id) & ~b.null)]
    return out


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return read_index(spark, path)
