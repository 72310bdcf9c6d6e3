"""URL filtering by host and path rules, spread over redirect and canonical-link aliases.

A rule (verdict, host, path) fits its host and all subdomains if the url's path starts with the rule's; the
longest rule that fits wins (by host, then path length; allow before block between equals). Urls that no
rule fits take the verdict of their aliases: pages are nodes of a graph whose edges are redirects (meta
refresh, and pairs given as ``redirects``), canonical links in the html, and the canonical form of the url
itself (scheme, port, fragment and tracking parameters dropped, host in lower case; a closing slash too, unless
``slashes`` is false). Targets are resolved against the page's <base> or url, dot segments and character
references included.
Within a connected component, a block spreads to urls without a rule, unless the component holds an
explicitly allowed url: allow takes precedence. A url with a rule of its own always keeps its verdict.

Defined results: a null url or one without :// has empty host and path, no rule, no aliases, and is
allowed; null html has no links; a target without a host (mailto:, an empty one of a url without ://) makes no edge;
repeated rows are judged alike; an empty table gives an empty result; urls and html of any length are read whole
(dot segments take the square of a path's segments); extra columns are not looked at. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, join_checked, let

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|msclkid|mc_cid|mc_eid)"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(url: Column, slashes: bool = True) -> Column:
    """The url without what does not tell pages apart; null if it has no host. slashes: closing ones go too."""
    rest = F.regexp_extract(url, r"(?s)^[^:/?#]+://(.*)$", 1)
    rest = F.regexp_replace(rest, r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, rf"(?i)([?&]){TRACKING}=[^&]*(?=&|$)", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"&{2,}", "&"), r"\?&+", "?"), r"[?&/]+$" if slashes else r"[?&]+$", "")
    host = F.regexp_replace(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), r":(?:80|443)$", "")
    return F.when(F.length(host) > 0, F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in whatever quotes; '' if there is none."""
    return F.concat(*[F.regexp_extract(tag, rf"(?is)^[^>]*?[\s\"']{name}{_VALUE}", i) for i in (1, 2, 3)])


def decoded(text: str) -> Column:
    """A column with its character references decoded, each once; unknown ones stay."""
    number = "if(t rlike '^&#[xX]', conv(substring(t, 4, length(t) - 4), 16, 10), substring(t, 3, length(t) - 3))"
    code = f"try_cast({number} as bigint)"
    char = f"if(coalesce({code} between 1 and 55295 or {code} between 57344 and 1114111, false), decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32'), t)"
    known = " ".join(f"WHEN t = '&{k};' THEN {v}" for k, v in (("amp", "'&'"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("apos", "'\\''"), ("nbsp", "' '")))
    tokens = f"regexp_extract_all({text}, '&(?:#[xX][0-9a-fA-F]{{1,6}}|#[0-9]{{1,7}}|[a-zA-Z]+);|[^&]+|&', 0)"
    return F.expr(f"if(contains({text}, '&'), array_join(transform({tokens}, t -> CASE {known} WHEN t like '&#%' THEN {char} ELSE t END), ''), {text})")


def resolved(rows: DataFrame, base: str, ref: str, out: str) -> DataFrame:
    """rows with out: the url that column ref names on a page of url base; step by step, so that the plan stays small."""
    rows = let(
        rows, _origin=F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1), _path=F.regexp_extract(base, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), _scheme=F.regexp_extract(base, r"^([^:/?#]+:)//", 1)
    )
    folder = "coalesce(nullif(regexp_extract(_path, '^(.*/)', 1), ''), '/')"
    rows = let(rows, _whole=F.expr(f"if(startswith({ref}, '/'), {ref}, concat({folder}, {ref}))"))
    rows = let(rows, _way=F.regexp_extract("_whole", r"^([^?#]*)", 1), _rest=F.regexp_extract("_whole", r"(?s)^[^?#]*(.*)$", 1))
    step = "CASE WHEN s = '.' THEN a WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 1)) ELSE array_append(a, s) END"
    short = f"aggregate(split(_way, '/', -1), cast(array() as array<string>), (a, s) -> {step}, a -> concat(array_join(a, '/'), if(_way rlike '/[.]{{1,2}}$', '/', '')))"
    named = F.expr(
        f"""CASE WHEN {ref} rlike '^[A-Za-z][A-Za-z0-9+.-]*:' THEN {ref} WHEN startswith({ref}, '//') THEN concat(_scheme, {ref})
          WHEN _origin = '' THEN null WHEN {ref} = '' OR startswith({ref}, '#') THEN {base} WHEN startswith({ref}, '?') THEN concat(_origin, _path, {ref})
          WHEN contains(_way, '/.') THEN concat(_origin, {short}, _rest) ELSE concat(_origin, _whole) END"""
    )
    return let(rows, **{out: named}).drop("_origin", "_path", "_scheme", "_whole", "_way", "_rest")


def _rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The first rule that fits, tried from the longest."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r[0], r[1], r[2]))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    none = F.lit(None).cast("struct<verdict:string,rule:string>")
    return reduce(lambda rest, r: F.when(fits(r[1], r[2]), F.struct(F.lit(r[0]).alias("verdict"), F.lit(f"{r[1]}{r[2]}").alias("rule"))).otherwise(rest), reversed(order), none)


def links(pages: DataFrame, slashes: bool = True) -> DataFrame:
    """(a, b): canonical forms of page and target, for canonical links and meta refreshes in the html."""
    tagged = pages.select("url", F.col("html").alias("h")).where(F.col("h").rlike("(?i)canonical|http-equiv") & F.col("url").isNotNull())
    tags = tagged.select("url", F.regexp_extract("h", r"(?i)(<base\b[^<>]*+>)", 1).alias("own"), F.explode(F.regexp_extract_all("h", F.lit(r"(?i)(<(?:link|meta)\b[^<>]*+>)"), 1)).alias("tag"))
    is_link = F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(?:^|\s)canonical(?:\s|$)") & F.col("tag").rlike("(?i)^<link")
    is_meta = (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh") & F.col("tag").rlike("(?i)^<meta")
    target = F.when(is_link, _attribute(F.col("tag"), "href")).when(is_meta, F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?i)\burl\s*=\s*[\"']?([^\"'\s]+)", 1))
    to = let(tags, _own=_attribute(F.col("own"), "href"), _to=F.trim(target)).where("length(_to) > 0")
    to = let(to, _own_url=decoded("_own"), _ref=decoded("_to")).select("url", "_own_url", "_ref")
    to = resolved(to, "url", "_own_url", "_own_base")
    to = let(to, _base=F.when(F.length("_own_url") > 0, F.col("_own_base")).otherwise(F.col("url")))
    to = resolved(to, "_base", "_ref", "_target")
    return let(to, a=canonical(F.col("url"), slashes), b=canonical(F.col("_target"), slashes)).select("a", "b").where("a is not null and b is not null")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, slashes: bool = True) -> DataFrame:
    """page_id, host, path, rule, verdict and the alias (component) of every row; redirects: (from_url, to_url)."""
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("alias", canonical(F.col("url"), slashes)).withColumn("r", _rule(rules))
    judged = cut(judged.select("page_id", "host", "path", "alias", "r"))
    edges = links(pages.select("url", "html"), slashes)
    if redirects is not None:
        a, b = redirects.columns[:2]
        edges = edges.unionByName(redirects.select(canonical(F.col(a), slashes).alias("a"), canonical(F.col(b), slashes).alias("b")))
    found = connected_components(edges)
    known = cut(judged.where("r is not null and alias is not null").groupBy("alias").agg(F.max(F.col("r.verdict") == "block").alias("blocks"), F.max(F.col("r.verdict") == "allow").alias("allows")))
    joined = known.join(found.withColumnRenamed("node", "alias"), "alias", "left")
    said = joined.groupBy(F.coalesce("component", "alias").alias("component")).agg(F.max("blocks").alias("blocks"), F.max("allows").alias("allows"))
    said = cut(said.where("blocks and not allows").select("component"))
    nodes = join_checked(found, said, ["component"], "left_semi", rows=300_000, size=F.length("component")).select(F.col("node").alias("alias"))
    blocked = cut(nodes.unionByName(said.select(F.col("component").alias("alias"))).distinct().withColumn("blocked", F.lit(True)))
    out = join_checked(judged, blocked, ["alias"], "left", rows=300_000, size=F.length("alias"))
    verdict = F.coalesce("r.verdict", F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "alias")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES) -> str:
    """DuckDB SQL for pages whose html names no other page; aliases are those of canonical urls."""
    order = sorted(rules, key=lambda r: (-len(r[1]), -len(r[2]), r[0], r[1], r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in order) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    return rf"""WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest,
  regexp_replace(regexp_extract(url, '(?s)^[^:/?#]+://(.*)$', 1), '(?s)#.*$', '') AS bare FROM pages),
h AS (SELECT page_id, coalesce({lower("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  array_to_string(list_filter(string_split(replace(bare, '?', '?&'), '&'), lambda x: NOT regexp_full_match(x, '(?i){TRACKING}=.*')), '&') AS bare FROM p),
c AS (SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS own,
  regexp_replace(regexp_replace(regexp_replace(bare, '&{{2,}}', '&', 'g'), '\?&+', '?', 'g'), '[?&/]+$', '') AS bare FROM h),
a AS (SELECT * EXCLUDE (bare), CASE WHEN regexp_extract(bare, '^([^/?#]*)', 1) <> '' THEN
  regexp_replace({lower("regexp_extract(bare, '^([^/?#]*)', 1)")}, ':(?:80|443)$', '') || regexp_extract(bare, '(?s)^[^/?#]*(.*)$', 1) END AS alias FROM c),
s AS (SELECT alias FROM a WHERE alias IS NOT NULL GROUP BY alias HAVING bool_or(own = 'block') AND NOT coalesce(bool_or(own = 'allow'), false))
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN alias IN (SELECT alias FROM s) THEN 'block' ELSE 'allow' END) AS verdict, alias FROM a"""


ORACLE_SQL = oracle()
