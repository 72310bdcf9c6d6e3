"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces, their scores and flags are read from a .model file; nothing is trained. Text is normalised the way
such a model states without a character map: a marker is put before the text and white space (U+0020)
becomes the marker. Since no piece continues over a marker, the text is cut before each run of markers and
every distinct part is segmented once: all parts of a batch go through the trie together, and each keeps its
best path of summed log scores, the first found among equals. A character without a piece costs the lowest
score less 10 and is written as its UTF-8 bytes (byte fallback). Decoding joins the pieces and bytes, turns
markers into spaces and drops the one put in front.

Scores of a BPE model are minus the rank of the piece; ``scores="zipf"`` (the default for such models)
reads them as ranks of a Zipf law, log p = -log(rank + 1), which is a proper unigram score; "model" takes
them as they are.

Defined results: null and empty text have no ids and decode to ''; text that holds the marker itself decodes
with a space in its place (``lossless`` is false); repeated rows are encoded each; an empty table gives an
empty result; extra columns pass untouched.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TwoAges, bounded_batches, give_back, session, worker_cache

MARK = "▁"
KNOWN_PARTS = 40_000
CELLS = 1 << 18
SLICE = 1 << 19
ENCODED = T.StructType(
    [T.StructField(x, T.LongType()) for x in ("n_tokens", "n_bytes_fallback", "ids_crc32")] + [T.StructField("lossless", T.BooleanType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protobuf message: whole numbers, or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            shift += 7
            if b < 128:
                return x

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """The vocabulary of a model file, its double-array trie and its scores."""

    def __init__(self, data: bytes, scores: str | None = None) -> None:
        self.texts: list[str] = []
        raw, kinds, unigram, self.prefix = [], [], True, True
        for field, value in _fields(data):
            if field == 1:
                piece = dict(_fields(value))
                self.texts.append(piece[1].decode())
                raw.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                unigram = dict(_fields(value)).get(3, 1) == 1
            elif field == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
        self.kinds = np.array(kinds)
        self.scores = np.array(raw, np.float64)
        if (scores or ("model" if unigram else "zipf")) == "zipf":
            normal = np.flatnonzero(np.isin(self.kinds, (NORMAL, USER)))
            rank = np.empty(len(normal))
            rank[np.argsort(-self.scores[normal], kind="stable")] = np.arange(len(normal))
            self.scores[normal] = -np.log(rank + 1.0)
        usable = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and self.texts[i]]
        self.unknown_score = float(self.scores[usable].min()) - 10.0
        self.unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
        self.bytes = np.full(256, -1, np.int64)
        self.pieces: list[bytes] = []
        for i, (t, k) in enumerate(zip(self.texts, kinds)):
            if k == BYTE:
                self.bytes[int(t[1:-1], 16)] = i
                self.pieces.append(bytes([int(t[1:-1], 16)]))
            else:
                self.pieces.append(b"" if k == CONTROL else t.replace(MARK, " ").encode() if k != UNKNOWN else " ⁇ ".encode())
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", self.texts[i]) for i in usable)
        self.base, self.check, self.value = double_array({self.texts[i].encode(): i for i in reversed(usable)})


def double_array(entries: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value: from state s, byte b leads to base[s] + b if check of that is s; value is -1 if no entry ends there."""
    tree: dict = {}
    for key, value in entries.items():
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = value
    size = 1 << 16
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    check[0] = 0
    start, window, todo = 1, 2048, deque([(0, tree)])
    while todo:
        state, node = todo.popleft()
        value[state] = node.get(-1, -1)
        codes = np.array(sorted(b for b in node if b >= 0), np.int64)
        if not len(codes):
            continue
        while (check[start : start + 1024] >= 0).mean() > 0.9:  # hardly a place left
            start += 1024
        look = start
        while True:
            if look + window + 512 >= len(base):
                base, check, value = (np.concatenate([x, np.full(len(x), f, np.int64)]) for x, f in ((base, 0), (check, -1), (value, -1)))
            at = np.flatnonzero(check[look : look + window] < 0) + look - codes[0]
            at = at[at > 0]
            for c in codes[1:]:
                at = at[check[at + c] < 0]
            if len(at):
                break
            look += window
        base[state] = at[0]
        check[at[0] + codes] = state
        todo.extend((int(at[0] + b), node[int(b)]) for b in codes)
    return base.astype(np.int32), check.astype(np.int32), value.astype(np.int32)


def segment(pieces: Pieces, parts: list[bytes]) -> list[bytes]:
    """The ids (<u4) of the best segmentation of each part; parts of like length go through the trie together."""
    out: list = [None] * len(parts)
    sizes = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = max(8, int(sizes[order[at]]) * 5 // 4)
        upto = int(np.searchsorted(sizes[order], longest, side="right"))
        upto = min(upto, at + max(1, CELLS // longest))
        who = order[at:upto]
        for i, ids in zip(who, _viterbi(pieces, [parts[i] for i in who])):
            out[i] = ids
        at = upto
    return out


def _viterbi(pieces: Pieces, parts: list[bytes]) -> list[bytes]:
    n, width = len(parts), max(map(len, parts))
    text = np.zeros((n, width + 4), np.uint8)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) for p in parts])
    text[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    starts = (text & 0xC0) != 0x80  # first bytes of characters
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0.0
    came = np.zeros((n, width + 1), np.int32)
    by = np.full((n, width + 1), -1, np.int32)
    for i in range(width):
        rows = np.flatnonzero((i < sizes) & starts[:, i])
        if not len(rows):
            continue
        lead = text[rows, i]
        ends = i + np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        single = np.zeros(len(rows), bool)
        live, state, here = np.arange(len(rows)), np.zeros(len(rows), np.int64), best[rows, i]
        j = i
        while len(live):
            step = pieces.base[state] + text[rows[live], j]
            ok = (j < sizes[rows[live]]) & (pieces.check[step] == state) & (step != 0)
            live, state = live[ok], step[ok].astype(np.int32)
            j += 1
            if not len(live):
                break
            value = pieces.value[state]
            hit = value >= 0
            who = live[hit]
            score = here[who] + pieces.scores[value[hit]]
            r = rows[who]
            better = score > best[r, j]
            best[r[better], j], came[r[better], j], by[r[better], j] = score[better], i, value[hit][better]
            single[who[ends[who] == j]] = True
        lone = np.flatnonzero(~single)
        if len(lone):
            r, e = rows[lone], ends[lone]
            score = here[lone] + pieces.unknown_score
            better = score > best[r, e]
            r, e = r[better], e[better]
            best[r, e], came[r, e], by[r, e] = score[better], i, -1
    rows, ends, steps = np.arange(n), sizes.copy(), []
    used = np.zeros(n, np.int64)
    odd = np.zeros(n, bool)  # parts with a character that no piece covers
    while len(rows):
        piece = by[rows, ends]
        steps.append((rows, piece))
        odd[rows[piece < 0]] = True
        used[rows] += 1
        ends = came[rows, ends]
        rows, ends = rows[ends > 0], ends[ends > 0]
    at = np.cumsum(used)  # each part's ids are filled in from its end
    ids = np.zeros(int(at[-1]) if n else 0, "<u4")
    for k, (rows, piece) in enumerate(steps):
        ids[at[rows] - 1 - k] = np.where(piece < 0, pieces.unknown, piece)
    data, bounds = ids.tobytes(), [0, *(at * 4).tolist()]
    out = [data[bounds[r] : bounds[r + 1]] for r in range(n)]
    for r in np.flatnonzero(odd):
        found, end, p = [], len(parts[r]), parts[r]
        while end:
            start, piece = int(came[r, end]), int(by[r, end])
            found.extend([piece] if piece >= 0 else (pieces.bytes[x] for x in reversed(p[start:end])) if pieces.bytes[0] >= 0 else [pieces.unknown])
            end = start
        out[r] = np.array(found[::-1], "<u4").tobytes()
    return out


class Codec:
    """Encodes and decodes; keeps the segmentation of parts met before, up to a bound."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.known = pieces, TwoAges(KNOWN_PARTS)
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+" if not pieces.crossing else "(?s).+", re.S)

    def split(self, text: str) -> list[str]:
        return self.parts.findall((MARK if self.pieces.prefix else "") + text.replace(" ", MARK))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; so many texts at a time as have SLICE characters."""
        out, at = [], 0
        while at < len(texts):
            upto, total = at, 0
            while upto < len(texts) and (upto == at or total + len(texts[upto] or "") <= SLICE):
                total += len(texts[upto] or "")
                upto += 1
            out += self._encode(texts[at:upto])
            at = upto
        return out

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        split = [self.split(t) if t else [] for t in texts]
        new = self.known.missing(set().union(*split))
        found = segment(self.pieces, [p.encode("utf-8", "replace") for p in new])
        self.known.update(zip(new, found))
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load(path: str | None = None, scores: str | None = None) -> Pieces:
    with open(path or default_model(), "rb") as f:
        return Pieces(f.read(), scores)


def _codec(shared) -> Codec:
    """This worker's codec for the broadcast pieces."""
    cache, (key, state) = worker_cache(), shared.value
    if key not in cache:
        pieces = Pieces.__new__(Pieces)
        pieces.__dict__.update(state)
        cache[key] = Codec(pieces)
    return cache[key]


def _share(spark: SparkSession, model: str | None, scores: str | None):
    return spark.sparkContext.broadcast((f"pieces {model} {scores}", load(model, scores).__dict__))  # as large as the model file


def _encoder(shared):
    @F.arrow_udf(ENCODED)
    def run(text: pa.Array) -> pa.Array:
        c = _codec(shared)
        found = c.encode_batch(text.to_pylist())
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = np.cumsum([0, *(len(x) // 4 for x in found)])
        raw = np.cumsum(np.r_[0, c.pieces.kinds[ids] == BYTE])
        columns = [
            pa.array(np.diff(ends)), pa.array(raw[ends[1:]] - raw[ends[:-1]]), pa.array([zlib.crc32(x) for x in found], pa.int64()),
            pa.array([c.decode(ids[a:b]) == (t.as_py() or "") for t, a, b in zip(text, ends, ends[1:])], pa.bool_()),
            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view("<i4"))),
        ]
        out = pa.StructArray.from_arrays(columns, ENCODED.names)
        del found, raw
        give_back()
        return out

    return run


def _decoder(shared):
    @F.arrow_udf(T.StringType())
    def run(ids: pa.Array) -> pa.Array:
        c = _codec(shared)
        return pa.array([c.decode(np.asarray(x.as_py(), np.int64)) if x.is_valid else "" for x in ids], pa.string())

    return run


def encode(docs: DataFrame, model: str | None = None, scores: str | None = None) -> DataFrame:
    """docs with _piece added: n_tokens, n_bytes_fallback, ids_crc32 (of the ids as <u4), lossless (decodes to the text) and ids."""
    spark = session(docs)
    bounded_batches(spark)
    return docs.withColumn("_piece", _encoder(_share(spark, model, scores))("text"))


def decode(df: DataFrame, ids: str, model: str | None = None) -> DataFrame:
    """df with decoded added: the text of an array of ids."""
    return df.withColumn("decoded", _decoder(_share(session(df), model, None))(ids))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fields = ("n_tokens", "n_bytes_fallback", "ids_crc32", "lossless")
    return encode(docs).select("doc_id", *[f"_piece.{x}" for x in fields], F.size("_piece.ids").cast("long").alias("n_ids"))
