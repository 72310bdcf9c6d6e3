"""Removal of runs of lines that repeat anywhere in the corpus.

A chunk is a pair of neighbouring lines with text (and the blank lines between them), or one line of at
least ``min_words`` words. Of every chunk that occurs more than once in the corpus, the first occurrence (in
order of doc_id, then of place) stays and the lines of the others go, after their bytes have been compared;
chunks whose hashes collide but whose bytes differ count as different. As each pair of a run that occurs
earlier occurs earlier too, and each pair found is such a run, exactly the lines go that lie in a run of two
lines or more, or are a line of min_words words, that occurs earlier: no boundary can hide an end of it.

Defined results: null and empty texts pass unchanged; repeated rows (same doc_id and text) count as one
occurrence, so their first chunks stay in each; a pair that shares a line with its own first occurrence (the
third of three equal lines) stays; where runs overlap, a line may go that is part of the first occurrence of
another run, but a copy of each line stays; a null doc_id sorts first; a document all of whose lines with
text went is left out by ``line_dedup`` and has an empty text and ``emptied`` in ``dedup_lines``;
n_chunks_removed counts stretches of lines removed; an empty table gives an empty result; extra columns pass
untouched. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_checked, let

DIVISOR, MIN_WORDS = 4, 50
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\x0c\r"


def _chunked(docs: DataFrame, divisor: int, min_words: int) -> DataFrame:
    """docs with _lines and _chunks: array of (text, whole: always true, start and end line). A barrier after each array that lambdas use.

    Chunks do not depend on divisor, which callers may still give.
    """
    rows = docs.where("text is not null")
    rows = let(rows, _lines=F.split("text", "\n", -1))
    rows = let(rows, _blank=F.transform("_lines", lambda x: F.length(F.btrim(x, F.lit(BLANK))) == 0))
    long = F.transform("_lines", lambda x: (F.length(x) >= 2 * min_words - 1) & (F.regexp_count(x, F.lit(WORD)) >= min_words))
    rows = let(rows, _at=F.expr("filter(sequence(0, size(_lines) - 1), i -> not _blank[i])"), _long=long)
    rows = let(
        rows,
        _spans=F.expr(
            """concat(transform(slice(_at, 1, greatest(size(_at) - 1, 0)), (a, j) -> named_struct('a', a, 'b', _at[j + 1])),
               transform(filter(_at, i -> _long[i]), i -> named_struct('a', i, 'b', i)))"""
        ),
    )
    chunks = "transform(_spans, s -> named_struct('text', array_join(slice(_lines, s.a + 1, s.b - s.a + 1), '\n'), 'whole', true, 'start', s.a, 'end', s.b))"
    return let(rows, _chunks=F.expr(chunks)).drop("_blank", "_long", "_at", "_spans")


def repeats(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS, hashed: Callable[[str], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, _hash of the text, _gone: the places of the chunks that repeat an earlier one); only texts with such.

    Hashes that repeat, and their places, are found on narrow rows (a few numbers a chunk). Only texts with such
    a chunk are read again to compare the bytes under each hash by their least and greatest text, which
    combines on the map side: a task sends at most two texts a hash, however often it occurs. Under hashes
    whose two texts differ, chunks are grouped by their bytes.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_hash"))
    listed = _chunked(keyed, divisor, min_words)
    chunk = F.struct(F.col("c.end") > F.col("c.start"), hashed("c.text"))
    narrow = listed.select("doc_id", "_hash", F.posexplode("_chunks").alias("pos", "c")).select("doc_id", "_hash", "pos", chunk.alias("c"))
    narrow = narrow.select("doc_id", "_hash", "pos", F.col("c.col1").alias("pair"), F.col("c.col2").alias("key"))
    place = F.struct("doc_id", "_hash", "pos")
    known = cut(narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("key", "first"))
    hits = join_checked(narrow, known, ["key"], "inner")
    at = cut(hits.groupBy("doc_id", "_hash").agg(F.collect_set(F.struct("pos", "pair", "key", "first")).alias("_hits")))  # as many as the text has chunks
    again = _with(keyed, at.withColumn("_hits", F.transform("_hits", lambda x: F.struct(x["pos"], x["key"]))), "_hits", 16)
    texts = _chunked(again, divisor, min_words).select("doc_id", "_hash", F.expr("inline(transform(_hits, x -> named_struct('pos', x.pos, 'key', x.key, 'chunk', _chunks[x.pos].text)))"))
    mixed = cut(texts.groupBy("key").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("key"))
    rows = at.select("doc_id", "_hash", F.inline("_hits"))
    alike = join_checked(rows, mixed, ["key"], "left_anti", salt=False)
    apart = join_checked(texts, mixed, ["key"], "inner")
    firsts = apart.groupBy("key", "chunk").agg(F.min(place).alias("first"))
    apart = apart.join(firsts, ["key", "chunk"]).withColumn("pair", F.contains("chunk", F.lit("\n"))).select(alike.columns)
    gone = alike.unionByName(apart).where(~place.eqNullSafe(F.col("first")))  # equal rows only
    beside = F.struct("doc_id", "_hash", F.expr("pos - 1").alias("pos"))  # three equal lines: the second pair shares one with the first
    gone = gone.where(~(F.col("pair") & beside.eqNullSafe(F.col("first"))))
    return gone.groupBy("doc_id", "_hash").agg(F.collect_set("pos").alias("_gone"))  # as many as the text has chunks


def _with(keyed: DataFrame, per_text: DataFrame, column: str, width: int, how: str = "inner") -> DataFrame:
    """keyed (doc_id, _hash, ...) with the array that per_text (doc_id, _hash, column) holds for the text; null doc_ids meet too."""
    number = per_text.select(F.xxhash64("doc_id").alias("_key"), "_hash", column)
    rows = keyed.withColumn("_key", F.xxhash64("doc_id"))
    return join_checked(rows, number, ["_key", "_hash"], how, rows=500_000, size=F.size(column) * width, salt=False).drop("_key")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text deduplicated, and n_chunks_removed and emptied added."""
    own = [F.col(f"_k{i}").alias(c) for i, c in enumerate(docs.columns)]  # no name of docs can clash with those used here
    row = docs.toDF(*[f"_k{i}" for i in range(len(own))])
    text, doc_id = (f"_k{docs.columns.index(c)}" for c in ("text", "doc_id"))
    row = row.withColumns({"_hash": F.xxhash64(text), "_key": F.xxhash64(doc_id)})
    gone = cut(repeats(docs, divisor, min_words))
    keyed = gone.withColumn("_key", F.xxhash64("doc_id")).drop("doc_id")
    marked = join_checked(row, keyed, ["_key", "_hash"], "left", rows=500_000, size=F.size("_gone") * 4, salt=False)
    same = marked.where("_gone is null").select(*own, F.lit(0).alias("n_chunks_removed"), F.lit(False).alias("emptied"))
    cutting = _chunked(marked.where("_gone is not null").withColumn("text", F.col(text)), divisor, min_words)
    cutting = let(cutting, _out=F.expr("array_distinct(flatten(transform(_gone, p -> sequence(_chunks[p].start, _chunks[p].end))))"))
    cutting = let(cutting, _left=F.expr("array_except(sequence(0, size(_lines) - 1), _out)"), _n=F.expr("size(array_except(_out, transform(_out, i -> i + 1)))"))
    cutting = let(cutting, _new=F.expr("transform(_left, i -> _lines[i])"), _rest=F.expr("exists(_left, i -> length(btrim(_lines[i], ' \\t\\n\\u000b\\u000c\\r')) > 0)"))
    new = F.when(F.col("_rest"), F.array_join("_new", "\n")).otherwise("").alias("text")
    fields = [new if c == "text" else own[i] for i, c in enumerate(docs.columns)]
    cutting = cutting.select(*fields, F.col("_n").alias("n_chunks_removed"), (~F.col("_rest")).alias("emptied"))
    return same.unionByName(cutting)


def line_dedup(docs: DataFrame, divisor: int = DIVISOR, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text deduplicated, without documents of which nothing is left; n_chars follows the text if present."""
    out = dedup_lines(docs, divisor, min_words).where("not emptied").drop("emptied")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chunks_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the deduplicated text, n_chunks_removed and emptied of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)


ORACLE_SQL = rf"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT doc_id, line, i, row_number() OVER w AS j, lead(i) OVER w AS next FROM l WHERE regexp_matches(line, '{WORD}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, array_to_string(ls[i:next], chr(10)) AS chunk, i AS a, next AS b, j FROM k JOIN d USING (doc_id) WHERE next IS NOT NULL
  UNION ALL SELECT doc_id, line, i, i, j FROM k WHERE len(regexp_extract_all(line, '{WORD}')) >= {MIN_WORDS}),
f AS (SELECT *, first_value(doc_id) OVER w AS d0, first_value(j) OVER w AS j0 FROM c WINDOW w AS (PARTITION BY chunk ORDER BY doc_id, j)),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM f WHERE (doc_id <> d0 OR j <> j0) AND NOT (b > a AND doc_id = d0 AND j = j0 + 1)),
n AS (SELECT doc_id, count(*) FILTER (WHERE before IS NULL OR before <> i - 1) AS n FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g) GROUP BY doc_id),
r AS (SELECT l.doc_id, array_to_string(list(line ORDER BY l.i) FILTER (WHERE g.i IS NULL), chr(10)) AS text, coalesce(bool_or(regexp_matches(line, '{WORD}')) FILTER (WHERE g.i IS NULL), false) AS rest
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i WHERE l.doc_id IN (SELECT doc_id FROM g) GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN n IS NULL THEN documents.text WHEN rest THEN r.text ELSE '' END AS text, coalesce(n, 0)::INT AS n_chunks_removed, n IS NOT NULL AND NOT rest AS emptied
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id)"""
