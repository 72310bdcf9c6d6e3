"""Quality rules with thresholds that adapt to each language and source.

Base counts come from the whole text. Four ratios of them are summarised for every (lang, source) by a
mergeable quantile sketch: a log-linear histogram whose bins keep two significant decimal digits, so two
sketches merge by adding counts, whatever the order, and size is at most 90 bins a decade. Thresholds are
outer fences (quartile plus or minus three interquartile ranges and a slack) read from the sketch of the
source; a source with fewer than min_group sketched documents takes the merged sketch of its language, and
a small language that of all documents. Documents are then filtered by a join with the thresholds.

Defined results: null or empty text has all counts 0 and fails the base rule; a null lang or source counts
as the empty string; repeated rows each count and each get a row; an empty table gives an empty result;
other columns of any name pass through ``quality_filter`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, give_back, join_checked, session

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: ratio -> (numerator, denominator, scale, slack above, slack below or None)
RATIOS = {
    "word_len": ("word_chars", "n_words", 100, 150, 150),
    "symbols": ("n_symbols", "n_words", 1000, 100, None),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 300, None),
    "repeats": ("n_repeat_words", "n_words", 1000, 150, None),
}
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a k-word window (k a power of two) found at two places or more, counted exactly."""
    n = len(words)
    if n <= k:
        return 0
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    step = 1
    while step < k:
        pair = x[:-step] * np.int64(n + 1) + x[step:]
        values, x, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        step *= 2
    marks = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[x] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + k, -1)
    return int((np.cumsum(marks)[:n] > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated_words(words)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in METRICS]))
def _counted(text: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([measure(t) for t in text], columns=list(METRICS), dtype="int64")
    give_back()
    return out


#: Said to be non-deterministic: else a filter on its result is pushed below a join and measures every text once more.
_metrics = _counted.asNondeterministic()


def _ratio(name: str, m: str) -> Column:
    top, under, scale, _, _ = RATIOS[name]
    return F.expr(f"{m}.{top} * {scale}L div greatest({m}.{under}, 1L)")


def _bin(v: Column) -> Column:
    """The lower end of v's bin: v with all but its two first digits zeroed."""
    step = F.pow(F.lit(10), F.greatest(F.length(v.cast("string")) - 2, F.lit(0))).cast("long")
    return v - v % step


def base_failed(m: str) -> Column:
    return F.expr(f"{m}.n_words < 20 or 100 * {m}.n_repeat_words > 30 * {m}.n_words")


def sketch(measured: DataFrame, m: str = "_m") -> DataFrame:
    """(_lang, _source, metric, bin, n): the quantile sketches of documents that pass the base rule."""
    values = F.array(*[F.struct(F.lit(k).alias("metric"), _bin(_ratio(k, m)).alias("bin")) for k in RATIOS])
    return (
        measured.where(~base_failed(m))
        .select("_lang", "_source", F.inline(values))
        .groupBy("_lang", "_source", "metric", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merges the sketches of each key and reads q25 and q75 from their bins."""
    merged = sketches.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    bins = merged.groupBy(*keys, "metric").agg(
        F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total")
    )  # at most 90 bins a decade
    upto = F.expr("transform(bins, (x, i) -> struct(x.bin as bin, aggregate(slice(bins, 1, i + 1), 0L, (s, y) -> s + y.n) as upto))")
    at = lambda q: F.expr(f"filter(upto, x -> x.upto * 4 >= total * {q})[0].bin")
    return bins.select(*keys, "metric", "total", upto.alias("upto")).select(*keys, "metric", "total", at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketches: DataFrame, groups: DataFrame, min_group: int) -> DataFrame:
    """One row for each (_lang, _source) of groups: its fences, from the finest sketch with min_group documents."""
    by_all = quartiles(sketches, []).withColumnsRenamed({"total": "t0", "q1": "a0", "q3": "b0"})
    by_lang = quartiles(sketches, ["_lang"]).withColumnsRenamed({"total": "t1", "q1": "a1", "q3": "b1"})
    by_source = quartiles(sketches, ["_lang", "_source"]).withColumnsRenamed({"total": "t2", "q1": "a2", "q3": "b2"})
    metrics = F.array(*[F.lit(k) for k in RATIOS])
    every = groups.withColumn("metric", F.explode(metrics))
    joined = every.join(by_source, ["_lang", "_source", "metric"], "left").join(by_lang, ["_lang", "metric"], "left").join(by_all, ["metric"], "left")
    pick = lambda c: F.expr(f"case when t2 >= {min_group} then {c}2 when t1 >= {min_group} then {c}1 else {c}0 end")
    q = joined.select("_lang", "_source", "metric", pick("a").alias("q1"), pick("b").alias("q3"))
    slack = F.create_map(*[x for k, r in RATIOS.items() for x in (F.lit(k), F.lit(r[3]))])
    q = q.withColumn("high", F.col("q3") + 3 * (F.col("q3") - F.col("q1")) + slack[F.col("metric")])
    below = F.create_map(*[x for k, r in RATIOS.items() if r[4] is not None for x in (F.lit(k), F.lit(r[4]))])
    q = q.withColumn("low", F.col("q1") - 3 * (F.col("q3") - F.col("q1")) - F.try_element_at(below, F.col("metric")))
    one = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"_{k}_{c}")
    return q.groupBy("_lang", "_source").agg(*[one(k, c) for k in RATIOS for c in ("high", "low")])


def _verdict(m: str) -> Column:
    ok = ~base_failed(m)
    for k, r in RATIOS.items():
        ok = ok & F.coalesce(_ratio(k, m) <= F.col(f"_{k}_high"), F.lit(True))
        if r[4] is not None:
            ok = ok & F.coalesce(_ratio(k, m) >= F.col(f"_{k}_low"), F.lit(True))
    return ok


def _keys(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs[c], F.lit("")).alias(f"_{c}") for c in ("lang", "source")]


def fit(docs: DataFrame, min_group: int = 100) -> tuple[DataFrame, DataFrame]:
    """(measured, thresholds): the counts of each document, written once, and the fences of each source."""
    bounded_batches(session(docs))
    measured = cut(docs.select("doc_id", *_keys(docs), _metrics("text").alias("_m")))
    sketches = cut(sketch(measured))
    fences = cut(thresholds(sketches, measured.select("_lang", "_source").distinct(), min_group))
    return measured, fences


def judge(measured: DataFrame, fences: DataFrame) -> DataFrame:
    joined = join_checked(measured, fences, ["_lang", "_source"], "left", rows=200_000)
    return joined.select(
        "doc_id", *[f"_m.{x}" for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")],
        base_failed("_m").alias("base_failed"), _verdict("_m").alias("kept"),
    )


def quality_rules(docs: DataFrame, min_group: int = 100) -> DataFrame:
    """doc_id, the counts, base_failed and kept for every row of docs."""
    return judge(*fit(docs, min_group))


def quality_filter(docs: DataFrame, min_group: int = 100) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs. Texts are never shuffled while the fences are small."""
    _, fences = fit(docs, min_group)
    wide = docs.select(F.struct("*").alias("_row"), *_keys(docs), _metrics("text").alias("_m"))
    joined = join_checked(wide, fences, ["_lang", "_source"], "left", rows=200_000)
    return joined.where(_verdict("_m")).select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_lines")


_BIN = "v - v % pow(10, greatest(length(v::VARCHAR) - 2, 0))::BIGINT"


def _level(name: str, keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    return f"""{name} AS (SELECT {by}, max(total) AS total, min(bin) FILTER (WHERE upto * 4 >= total) AS q1, min(bin) FILTER (WHERE upto * 4 >= total * 3) AS q3
  FROM (SELECT {by}, bin, sum(n) OVER (PARTITION BY {by} ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}) AS total
        FROM (SELECT {by}, bin, sum(n) AS n FROM sk GROUP BY {by}, bin)) GROUP BY {by})"""


def _pick(c: str, metric: str) -> str:
    return f"""(SELECT CASE WHEN s.total >= 100 THEN s.{c} WHEN l.total >= 100 THEN l.{c} ELSE a.{c} END FROM (SELECT '{metric}' AS metric) x
  LEFT JOIN by_source s ON s.metric = x.metric AND s.lang = g.lang AND s.source = g.source
  LEFT JOIN by_lang l ON l.metric = x.metric AND l.lang = g.lang LEFT JOIN by_all a ON a.metric = x.metric)"""


def _oracle() -> str:
    ratio = {k: f"{r[0]} * {r[2]} // greatest({r[1]}, 1)" for k, r in RATIOS.items()}
    values = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {v} AS v FROM good" for k, v in ratio.items())
    fences = ", ".join(f"{_pick('q1', k)} AS {k}_q1, {_pick('q3', k)} AS {k}_q3" for k in RATIOS)
    tests = []
    for k, r in RATIOS.items():
        tests.append(f"coalesce({ratio[k]} <= {k}_q3 + 3 * ({k}_q3 - {k}_q1) + {r[3]}, true)")
        if r[4] is not None:
            tests.append(f"coalesce({ratio[k]} >= {k}_q1 - 3 * ({k}_q3 - {k}_q1) - {r[4]}, true)")
    space = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]"
    return f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, regexp_extract_all(text, '{word}+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, range(0, 8) r(j) GROUP BY doc_id),
m AS (SELECT t.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(cov.n, 0) AS n_repeat_words FROM t LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
good AS (SELECT * FROM b WHERE NOT base_failed),
sk AS (SELECT lang, source, metric, {_BIN} AS bin, count(*) AS n FROM ({values}) GROUP BY ALL),
{_level('by_all', '')}, {_level('by_lang', 'lang')}, {_level('by_source', 'lang, source')},
f AS (SELECT g.lang, g.source, {fences} FROM (SELECT DISTINCT lang, source FROM b) g)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept
FROM b JOIN f USING (lang, source)"""


ORACLE_SQL = _oracle()
