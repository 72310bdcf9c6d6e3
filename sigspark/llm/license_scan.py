"""Licence scan with a positional index on rare words.

1. Every text is split into words once; of these the places of licence words (all words of templates and
   base phrases) are kept, so later steps never see a text. Their document frequencies over the whole corpus
   give the IDF of each licence word.
2. The index has a posting list for each licence word: the templates of which it is the highest-IDF word among
   those of the mandatory phrases, with its places and those of the next rarest word. A file looks up its
   licence words; a posting counts if the file has every mandatory word of the template, so a file comes to a
   template by the highest-IDF words that both have.
3. Each place of such a word in the file says where the template would have to start. The offsets that the two
   rarest words say are intersected, and each mandatory key phrase is verified at its place relative to the
   offset, again by intersecting offsets. No step tries all pairs of places: work is linear in a file's licence
   words and in the templates that its rare words name.
4. The score of a file is the best share of a template's words that stand at their places, or 0.5 for a file in
   which only a base phrase was found.

Base: places where a base phrase's words stand consecutively. Words are lower-cased (A-Z) runs of digits,
letters and characters beyond ASCII.

Templates are data: the index is one constant, and the plan does not grow with their number. The IDF decides
which words are looked up, never what is found.

Defined results: null and empty texts have no words and labels ''; repeated rows are scanned each; of templates
equally rare words, the first in the alphabet is looked up; texts of any length are scanned whole (up to 2^31
words); an empty table gives an empty result; extra columns of any name are not looked at. Built-in functions
only; nothing but the licence words' frequencies (as many as the templates have words) comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: label, template, mandatory key phrases
TEMPLATES = (
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "2 0")),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
)
#: A hit is one long: the place of the word, then WORD_BITS of its number in the vocabulary.
WORD_BITS = 24
MASK, STEP = (1 << WORD_BITS) - 1, 1 << WORD_BITS
Templates = Sequence[tuple[str, str, Sequence[str]]]

#: The characters that part words, and capital letters, with what they become.
PARTING = "".join(chr(i) for i in range(128) if not chr(i).isalnum())

_PHRASE = "array<struct<at:bigint,first:bigint,steps:array<bigint>>>"
_TEMPLATE = f"struct<label:string,needs:array<bigint>,a:bigint,a_at:array<bigint>,b:bigint,b_at:array<bigint>,phrases:{_PHRASE},words:array<bigint>>"


def vocabulary(templates: Templates, base: Sequence[tuple[str, str]]) -> list[str]:
    """All licence words, short ones first: a word's number is its place from 1."""
    return sorted({w for _, t, _ in templates for w in t.split()} | {w for p, _ in base for w in p.split()}, key=lambda w: (len(w), w))


def hits(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, n_words and _h, the licence words of each text in order, as hits. The one pass over texts."""
    plain = F.translate("text", PARTING + UPPER, " " * len(PARTING) + LOWER)
    rows = let(docs.select("doc_id", "text"), _w=F.array_remove(F.split(plain, " "), "")).drop("text")
    known = F.lit(words)
    found = F.transform("_w", lambda w, i: F.when(w.isin(words), F.shiftleft(i.cast("long"), WORD_BITS) + F.array_position(known, w)))
    none = F.array().cast("array<bigint>")
    return rows.select("doc_id", F.coalesce(F.size("_w"), F.lit(0)).cast("long").alias("n_words"), F.coalesce(F.array_compact(found), none).alias("_h")).withColumn(
        "n_words", F.greatest("n_words", F.lit(0))
    )


def idf(found: DataFrame, words: list[str]) -> dict[str, float]:
    """The IDF of every licence word, over all documents."""
    each = found.select(F.explode(F.expr(f"array_distinct(transform(_h, h -> h & {MASK}L))")).alias("w"))
    frequency = {r["w"]: r["count"] for r in each.groupBy("w").count().collect()}  # at most the vocabulary
    n = found.count()
    return {w: log((n + 1) / (frequency.get(i, 0) + 1)) for i, w in enumerate(words, 1)}


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _phrase(phrase: list[str], at: int, number: dict[str, int]) -> dict:
    """A phrase as differences to the hit of its first word: a hit's successors are the next licence words, and equal differences mean the next places too."""
    first = number[phrase[0]]
    return {"at": at, "first": first, "steps": [k * STEP + number[w] - first for k, w in enumerate(phrase)]}


def index(templates: Templates, weights: dict[str, float], number: dict[str, int]) -> tuple[list[list[int]], list[dict]]:
    """(posting lists by word number, templates): a template is listed under the highest-IDF word of its mandatory phrases."""
    lists: list[list[int]] = [[] for _ in range(len(number) + 1)]
    entries = []
    for label, text, phrases in templates:
        t = text.split()
        places = lambda w: [i for i, x in enumerate(t) if x == w]  # noqa: B023, E731
        needs = sorted({w for p in phrases for w in p.split()}, key=lambda w: (-weights[w], w))
        a, b = needs[0], needs[min(1, len(needs) - 1)]
        starts = [next(i for i in range(len(t)) if t[i : i + len(p)] == p) for p in map(str.split, phrases)]
        entries.append(
            {
                "label": label, "needs": [number[w] for w in needs], "a": number[a], "a_at": places(a), "b": number[b], "b_at": places(b),
                "phrases": [_phrase(p.split(), at, number) for p, at in zip(phrases, starts)], "words": [number[w] for w in t],
            }
        )
        lists[number[a]].append(len(entries) - 1)
    return lists, entries


def _starts(phrase: str) -> str:
    """SQL for the offsets (place less the phrase's place in its template) at which a phrase stands among the hits."""
    here = f"h & {MASK}L = {phrase}.first and slice(_h, j + 1, size({phrase}.steps)) = transform({phrase}.steps, d -> h + d)"
    return f"filter(transform(_h, (h, j) -> if({here}, shiftright(h, {WORD_BITS}) - {phrase}.at, null)), o -> o is not null)"


def _offsets(word: str, at: str) -> str:
    """SQL for the offsets at which a template would start, from the places of one of its words."""
    return f"flatten(transform(filter(_h, h -> h & {MASK}L = {word}), h -> transform({at}, i -> shiftright(h, {WORD_BITS}) - i)))"


def scan(docs: DataFrame, templates: Templates = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> DataFrame:
    """One row a document: n_words, the base places and labels, all labels and the score."""
    words = vocabulary(templates, base)
    number = {w: i for i, w in enumerate(words, 1)}
    rows = cut(hits(docs, words))
    lists, entries = index(templates, idf(rows, words), number)
    bases = [_phrase(p.split(), 0, number) | {"label": label} for p, label in base]
    rows = let(rows, _present=F.expr(f"array_distinct(transform(_h, h -> h & {MASK}L))"))
    rows = let(rows, _lists=_constant(lists, "array<array<int>>"), _all=_constant(entries, f"array<{_TEMPLATE}>"), _base=_constant(bases, "array<struct<at:bigint,first:bigint,steps:array<bigint>,label:string>>"))
    named = "filter(flatten(transform(_present, w -> _lists[w])), t -> size(array_except(_all[t].needs, _present)) = 0)"
    rows = let(rows, _t=F.expr(f"transform({named}, t -> _all[t])"), _b=F.expr(f"filter(transform(_base, p -> struct(p.label as label, {_starts('p')} as places)), p -> size(p.places) > 0)"))
    meet = f"array_intersect({_offsets('t.a', 't.a_at')}, {_offsets('t.b', 't.b_at')})"
    verified = f"aggregate(t.phrases, {meet}, (o, p) -> array_intersect(o, {_starts('p')}))"
    rows = let(rows, _f=F.expr(f"filter(transform(_t, t -> struct(t.label as label, t.words as words, {verified} as places)), t -> size(t.places) > 0)")).drop("_lists", "_all", "_base", "_t", "_present")
    # each found offset once for every word of the template that stands at its place; the longest run of equal ones counts
    here = f"array_sort(flatten(transform(f.words, (w, i) -> array_intersect(f.places, {_offsets('w', 'array(i)')}))))"
    run = "if(x <=> s.v, s.n + 1, 1)"
    most = f"aggregate({here}, named_struct('v', cast(null as bigint), 'n', 0, 'most', 0), (s, x) -> named_struct('v', x, 'n', {run}, 'most', greatest(s.most, {run})), s -> s.most)"
    best = F.expr(f"array_max(transform(_f, f -> {most} / cast(size(f.words) as double)))")
    places = F.flatten("_b.places")
    rows = let(rows, _p=places, _best=best)
    listed = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return rows.select(
        "doc_id", "n_words", F.size("_p").cast("long").alias("n_base"), F.array_min("_p").alias("first_word"), F.array_max("_p").alias("last_word"), listed(F.col("_b.label")).alias("base_labels"),
        listed(F.concat("_b.label", "_f.label")).alias("labels"), F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.size("_p") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(templates: Templates = TEMPLATES, base: Sequence[tuple[str, str]] = BASE) -> str:
    """DuckDB SQL for scan over documents."""
    longest = max(len(p.split()) for p in [*(p for _, _, ps in templates for p in ps), *(p for p, _ in base)])
    phrases = [(f"b{i}", 0, p) for i, (p, _) in enumerate(base)]
    for i, (_, text, ps) in enumerate(templates):
        t = text.split()
        phrases += [(f"t{i}", next(k for k in range(len(t)) if t[k : k + len(p.split())] == p.split()), p) for p in ps]
    listed = ", ".join(f"('{k}', {at}, '{p} ', '{p.split()[0]}')" for k, at, p in phrases)
    labels = ", ".join([*(f"('b{i}', '{label}', 0, 0)" for i, (_, label) in enumerate(base)), *(f"('t{i}', '{label}', {len(ps)}, {len(t.split())})" for i, (label, t, ps) in enumerate(templates))])
    words = ", ".join(f"('t{i}', {j}, '{w}')" for i, (_, t, _) in enumerate(templates) for j, w in enumerate(t.split()))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{word}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
ahead AS (SELECT doc_id, i, word, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {longest - 1} FOLLOWING), ' ') || ' ' AS ahead FROM x),
p(k, place, phrase, first) AS (VALUES {listed}), l(k, label, phrases, size) AS (VALUES {labels}), tw(k, j, word) AS (VALUES {words}),
f AS (SELECT doc_id, p.k, i - place AS o, phrase FROM ahead JOIN p ON ahead.word = p.first AND starts_with(ahead.ahead, p.phrase)),
b AS (SELECT doc_id, count(*) AS n, min(o) AS first_word, max(o) AS last_word, list(DISTINCT label) AS names FROM f JOIN l USING (k) WHERE l.phrases = 0 GROUP BY doc_id),
t AS (SELECT doc_id, k, o FROM f JOIN l USING (k) WHERE l.phrases > 0 GROUP BY doc_id, k, o, l.phrases HAVING count(DISTINCT phrase) = l.phrases),
s AS (SELECT t.doc_id, t.k, t.o, count(*) / any_value(l.size)::DOUBLE AS share FROM t JOIN tw ON tw.k = t.k JOIN x ON x.doc_id = t.doc_id AND x.i = t.o + tw.j AND x.word = tw.word JOIN l ON l.k = t.k GROUP BY ALL),
m AS (SELECT doc_id, max(share) AS best, list(DISTINCT label) AS names FROM s JOIN l USING (k) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.names, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.names, []), coalesce(m.names, [])))), ',') AS labels,
  greatest(coalesce(m.best, 0.0), CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""


ORACLE_SQL = oracle()
