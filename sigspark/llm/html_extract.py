"""Main text of web pages by consensus of each host's pages.

1. Every page is read into a light tree by one pass over its tags. Each container (an element that holds
   text blocks of its own) is scored: characters of its blocks outside boilerplate, less those in links.
2. The containers of each page vote for their generalised path (tag and class names from the root,
   digits in class names replaced by #). Spark adds the votes up by host and path, and the path with the
   highest score per page of the host wins.
3. The winners are joined to the pages, which are read again: the elements on the winning path, or, on a
   page without it, the page's own best container, are widened to the nearest article around them, else the
   nearest main, else the outermost container below body with further text of its own, and give the text.

Blocks are block-level elements and table cells; <br> is white space in a block. Boilerplate inside the
container (by tag, role or class and id words) is left out: menus, headers and footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments. Words that are also used of content (side, share, alert) mark
boilerplate as a whole class or id, or outside an article; as a part of one inside an article, only if most of
the text there is in links. A header in an article keeps its headings.

Defined results: null, empty or textless html gives ''; a null or host-less url votes with host ''; repeated
rows vote and return once each; of paths with equal votes the first wins; pages of any length are read in one
pass, unclosed tags and quotes included; elements nested deeper than 512 are read as children of that level; an
empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut, join_checked, session

#: A tag ends before the next <, outside quotes; possessive, so a tag that never ends is given up where it breaks off.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "fieldset", "label", "datalist"} | RAW
BLOCKS = set(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTAINERS = {"article", "body", "div", "main", "section", "td", "center", "blockquote"}
#: Elements that an opening tag closes, up to the nearest of the bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
#: Deeper elements are read as children of this level, as browsers do.
DEEPEST = 512
#: Words of boilerplate anywhere in a class or id; those that mark it as a whole class or id, and are a hint as a part of one.
NOISE = re.compile(
    r"^(?:ads?|advert\w*|sponsor\w*|comments?|commentlist|disqus|sidebar|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|cookies?|consent|gdpr|newsletter|subscription|sharing|"
    r"pagination|pager|toolbar|outbrain|taboola)$"
)
HINT = re.compile(
    r"^(?:banner|promo\w*|replies|respond|side|menu|foot|notice|notices|alert|popup|modal|overlay|subscribe|signup|login|search|share|social|related|recommended|widget|skip|disclaimer)$"
)
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}


class _Node:
    """An element, with what its ancestors make of it, so that nothing has to climb."""

    __slots__ = ("tag", "path", "hidden", "up", "chars", "links", "holder", "box", "heading", "in_header", "article", "anchor", "hint", "p", "hint_chars", "hint_links")

    def __init__(self, tag: str, path: str, hidden: bool, up: _Node | None, place: int, header: bool = False, hint: bool = False) -> None:
        self.tag, self.path, self.hidden, self.up = tag, path, hidden, up
        self.chars = self.links = self.hint_chars = self.hint_links = 0
        self.holder = self if up is None or tag in BLOCKS else up.holder
        self.box = self if up is None or tag in CONTAINERS else up.box
        self.heading = tag in HEADINGS or (up is not None and up.heading)
        self.in_header = header or (up is not None and up.in_header)
        self.article = tag in ("article", "main") or (up is not None and up.article)
        self.anchor = tag == "a" or (up is not None and up.anchor)
        self.hint = self if hint else up.hint if up is not None else None
        self.p = place if tag == "p" else 0 if up is None or tag in ("td", "th", "table") else up.p  # where in the stack a paragraph is open


def _names(attrs: str) -> tuple[str, bool, bool, bool]:
    """The generalised classes, and whether class, id, role or hidden mark boilerplate, may mark it, or mark a header."""
    classes, noise, hint, header = "", False, False, False
    for name, *values in ATTR.findall(attrs):
        value, name = "".join(values).strip().lower(), name.lower()
        if name in ("class", "id"):
            for x in value.split():
                words = re.split(r"[-_]+|\d+", x)
                noise = noise or any(NOISE.match(w) for w in (x, *words)) or bool(HINT.match(x))
                hint = hint or any(HINT.match(w) for w in words)
                header = header or "header" in words
            if name == "class":
                classes = "".join("." + re.sub(r"\d+", "#", x) for x in sorted(value.split()))
        elif name == "role":
            noise = noise or value in NOISE_ROLES
        elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            noise = True
    return classes, noise or bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", ATTR.sub(" ", attrs))), hint, header


def read(source: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """The blocks in page order, each with the node that holds it, and all containers."""
    root = _Node("", "", False, None, 0)
    stack, blocks, containers = [root], [], []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = 0
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if pieces:
            found = " ".join(_html.unescape("".join(pieces)).split())
            pieces.clear()
            if found:
                blocks.append((stack[-1].holder, found, linked))
        linked = 0

    def leave(depth: int) -> None:
        for x in stack[depth:]:
            opened[x.tag] -= 1
        del stack[depth:]

    def close(depth: int) -> None:
        if any(x.tag in BLOCKS for x in stack[depth:]):
            flush()
        leave(depth)

    while at < n:
        m = TAG.search(source, at)
        upto = m.start() if m else n
        if upto > at and not stack[-1].hidden:
            pieces.append(source[at:upto])
            if stack[-1].anchor:
                linked += upto - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    flush()
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:  # inline ends don't close blocks
                    break
            continue
        if tag == "br" or tag == "wbr":
            pieces.append(" " if tag == "br" and not stack[-1].hidden else "")
            continue
        if tag in BLOCKS:
            flush()
            if stack[-1].p:  # a block ends an open paragraph
                leave(stack[-1].p)
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                leave(len(stack) - 1)
        if tag in CLOSES and any(opened[x] for x in CLOSES[tag][0]):
            ends, bounds = CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in bounds:
                    break
                if stack[i].tag in ends:
                    close(i)
                    break
        if tag in VOID:
            continue
        if len(stack) >= DEEPEST:
            close(DEEPEST - 1)
        classes, noise, hint, header = _names(m[3]) if m[3] else ("", False, False, False)
        up = stack[-1]
        wide = tag in ("html", "body", "article", "main")
        header = not wide and (header or tag == "header")
        hidden = up.hidden or tag in DROPPED or not wide and (noise or not up.article and (hint or header))
        path = f"{up.path}>{tag}{classes}" if tag in BLOCKS else up.path
        node = _Node(tag, path, hidden, up, len(stack), header, hint and not wide)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            at = end.end() if end else n
            continue
        stack.append(node)
        opened[tag] += 1
        if tag in CONTAINERS and not hidden:
            containers.append(node)
    flush()
    return _settled(blocks, [root, *containers])


def _settled(blocks: list[tuple[_Node, str, int]], containers: list[_Node]) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """In an article, what a hint marks goes if most of its text is in links; the rest is counted to its container."""
    for node, text, linked in blocks:
        hint = node.hint
        while hint is not None:
            hint.hint_chars += len(text)
            hint.hint_links += linked
            hint = hint.up.hint
    out = []
    for node, text, linked in blocks:
        hint = node.hint
        while hint is not None and 2 * hint.hint_links <= hint.hint_chars:
            hint = hint.up.hint
        if hint is None:
            node.box.chars += len(text)
            node.box.links += linked
            out.append((node, text))
    return out, containers


def _kept(node: _Node) -> bool:
    """Whether a block of this node is no boilerplate: in a header, only headings are kept."""
    return not node.hidden and (node.heading or not node.in_header)


def _totals(blocks: list[tuple[_Node, str]], containers: list[_Node]) -> list[tuple[float, _Node]]:
    """Containers by score, best first: own text outside links, that of nested ones at half weight a level."""
    inner: dict[int, float] = {}
    scores = []
    for node in reversed(containers):  # the nested before those around them
        total = max(0, node.chars - 2 * node.links) + inner.pop(id(node), 0.0)
        if total:
            scores.append((total * (2.0 if node.tag in ("article", "main") else 1.0), node))
            if node.up is not None:
                inner[id(node.up.box)] = inner.get(id(node.up.box), 0.0) + total / 2
    return sorted(scores, key=lambda s: (-s[0], s[1].path))


def _widened(chosen: dict[int, _Node], blocks: list[tuple[_Node, str]]) -> set[int]:
    """The ids of the containers that give the text: chosen ones, or what is around them and holds more of the article."""
    more: set[int] = set()
    for node, _ in blocks:
        above, up, inner = [], node, None
        while up is not None and id(up) not in chosen:
            above.append(id(up))
            inner = inner or (up if up.tag in CONTAINERS else None)
            up = up.up
        if up is None and inner is not None and inner.chars > 2 * inner.links and _kept(node):
            more.update(above)
    out = set()
    for node in chosen.values():
        around, up = [], node
        while up is not None and up.tag not in ("body", "html", ""):
            if up.tag in CONTAINERS and not up.hidden:
                around.append(up)
            up = up.up
        whole = next((x for t in ("article", "main") for x in around if x.tag == t), None)
        out.add(id(whole or next((x for x in reversed(around) if id(x) in more), node)))
    return out


def votes(source: str | None) -> list[tuple[str, int]]:
    """The generalised paths of the page's containers with their whole-number scores."""
    if not source:
        return []
    best: dict[str, int] = {}
    for score, node in _totals(*read(source)):
        best[node.path] = best.get(node.path, 0) + round(score)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def extract(source: str | None, path: str | None) -> str:
    """The blocks under the elements on path, joined by blank lines; of the best container if none is there."""
    if not source:
        return ""
    blocks, containers = read(source)
    chosen = {id(x): x for x in containers if x.path == path and not x.hidden}
    if not chosen:
        best = _totals(blocks, containers)
        if not best:
            return ""
        chosen = {id(best[0][1]): best[0][1]}
    wide = _widened(chosen, blocks)
    out = []
    for node, text in blocks:
        up: _Node | None = node
        while up is not None and id(up) not in wide:
            up = up.up
        if up is not None and _kept(node):
            out.append(text)
    return "\n\n".join(out)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.LongType())])))
def _votes(source: pd.Series) -> pd.Series:
    return pd.Series([[{"path": p, "score": s} for p, s in votes(x)] for x in source], dtype=object)


@F.pandas_udf(T.StringType())
def _extract(source: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([extract(x, p if isinstance(p, str) else None) for x, p in zip(source, path)], dtype=object)


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^.*?://([^/?#]*)", 1))


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): the container path with the most votes of each host."""
    cast = pages.select(host_of("url").alias("host"), F.inline(_votes("html")))
    tally = cast.groupBy("host", "path").agg(F.sum("score").alias("score"))
    return tally.groupBy("host").agg(F.min_by("path", F.struct(-F.col("score"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and the container path of every row of pages."""
    bounded_batches(session(pages))
    won = cut(winners(pages))
    rows = pages.select("page_id", "url", "html", host_of("url").alias("host"))
    joined = join_checked(rows, won, ["host"], "left", rows=200_000)
    out = joined.select("page_id", "url", _extract("html", "path").alias("text"), "path")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
