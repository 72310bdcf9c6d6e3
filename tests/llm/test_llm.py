import itertools
import random
import zlib

import numpy as np
import pytest

from sigspark.llm import decontaminate as dc
from sigspark.llm import html_extract as he
from sigspark.llm import license_scan as ls
from sigspark.llm import line_dedup as ld
from sigspark.llm import near_dedup as nd
from sigspark.llm import piece_codec as pc
from sigspark.llm import quality_rules as qr
from sigspark.llm import sharding as sh
from sigspark.llm import token_store as ts
from sigspark.llm import url_filter as uf
from sigspark.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _w int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i == 1 else "en", "s", None, 0) for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_quality_counts_and_edges(spark):
    words = prose(1, 60)
    texts = [None, "", " ".join(words), " ".join(words[:10] * 6), "a\na\nb " * 3, "x" * 50_000, " ".join(words)]
    rows = {r.doc_id: r for r in qr.quality_rules(docs(spark, texts)).collect()}
    assert rows[0].n_words == 0 and rows[0].base_failed and not rows[0].kept
    assert rows[2].kept and not rows[2].base_failed
    assert rows[3].n_repeat_words == 60 and rows[3].base_failed
    assert qr.quality_filter(docs(spark, texts)).columns == ["doc_id", "text", "lang", "source", "n_chars", "_w"]
    assert qr.quality_rules(docs(spark, [])).count() == 0

    def slow(w, k=8):
        at = {}
        for i in range(len(w) - k + 1):
            at.setdefault(tuple(w[i : i + k]), []).append(i)
        return len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(k)})

    for seed in range(20):
        r = random.Random(seed)
        w = [bytes([r.randrange(97, 100)]) for _ in range(r.randrange(60))]
        assert qr.repeated_words(w) == slow(w)


def _components(sets, percent):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: find(i) for i in sets}


def _shingles(t, k=3):
    w = nd.words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.mark.parametrize(("block", "band"), [(1024, 32), (16, 4), (5, 2)])
def test_near_dedup_equals_brute_force(spark, monkeypatch, block, band):
    monkeypatch.setattr(nd, "BLOCK_DOCS", block)  # small ones part the group, so that it is verified over many tasks
    monkeypatch.setattr(nd, "SMALL_BAND", band)
    r = random.Random(5)
    base = prose(7, 120)
    texts = [None, "", "one two", "ONE two", " ".join(base)]
    for _ in range(90):  # a large group of near copies around the threshold
        w = list(base)
        for _ in range(r.randrange(1, 12)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(prose(100 + i, 50)) for i in range(20)] + [" ".join(base)]
    got = {x.doc_id: x for x in nd.components(docs(spark, texts), k=3, percent=85).collect()}

    sets = {i: _shingles(t) for i, t in enumerate(texts)}
    assert {i: x.component_id for i, x in got.items()} == _components(sets, 85)
    assert all(got[i].n_shingles == len(s) for i, s in sets.items())
    kept = nd.near_dedup(docs(spark, texts).union(docs(spark, texts[:3])), k=3, percent=85)
    assert kept.count() == sum(x.kept for x in got.values()) and kept.columns[-1] == "_w"
    assert nd.components(docs(spark, [])).count() == 0


def test_near_dedup_of_chains(spark, monkeypatch):
    """A large cell whose members are alike in chains only, among copies of one set in other words' order and case."""
    monkeypatch.setattr(nd, "BLOCK_DOCS", 8)
    monkeypatch.setattr(nd, "SMALL_BAND", 3)
    r, w, texts = random.Random(9), prose(21, 80), []
    for i in range(70):
        if i % 3 == 0:
            w = list(w)
            w[r.randrange(len(w))] = f"c{i}"
        texts.append(" ".join(w).upper() if i % 5 == 0 else "  ".join(w))
    got = {x.doc_id: x.component_id for x in nd.components(docs(spark, texts), k=3, percent=85).collect()}
    assert got == _components({i: _shingles(t) for i, t in enumerate(texts)}, 85)


def test_near_dedup_of_clashing_ids(spark):
    a, b = prose(1, 120), prose(2, 120)
    near = lambda w: [*w[:-1], "other"]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(near(a))), (3, " ".join(near(b))), (None, " ".join(a)), (4, None), (4, ""), (4, None), (1, " ".join(a)), (5, "x" * 300_000)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, h int").withColumnRenamed("h", "_h")
    got = [(x.doc_id, x.component_id, x.kept) for x in nd.components(df, k=3, percent=85).collect()]
    want = [(1, 1, True)] * 3 + [(2, 1, False), (3, 1, False), (None, None, True)] + [(4, 4, True)] * 3 + [(5, 5, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = nd.near_dedup(df, k=3, percent=85)
    assert kept.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in kept.collect()), key=str) == sorted({(rows[i]) for i in (0, 1, 4, 5, 6, 9)}, key=str)
    twice = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(near(a))), (7, " ".join(a))], "doc_id long, text string")
    assert nd.near_dedup(twice, k=3, percent=85).count() == 1


def test_sharding(spark):
    texts = [None, "", "é", *["x" * (i % 97) for i in range(400)], "y" * 5000]
    rows = sorted(sh.shards(docs(spark, texts)).collect(), key=lambda x: x.doc_id)
    assert [x.size for x in rows] == [len((t or "").encode()) + 1 for t in texts]
    assert [x.text_crc32 for x in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    assert [x.shard for x in rows] == sorted(x.shard for x in rows)
    for k in range(8):
        assert sorted(x.slot for x in rows if x.shard == k) == list(range(sum(x.shard == k for x in rows)))
    sizes = [sum(x.size for x in rows if x.shard == k) for k in range(8)]
    assert max(sizes) - sum(sizes) / 8 <= 5001
    assert sh.shards(docs(spark, [])).count() == 0


def test_sharding_equals_brute_force(spark):
    r = random.Random(4)
    rows = [(None if i < 5 else i // 2, r.choice([None, "", "é" * r.randrange(50), "x" * r.randrange(3000)]), "x") for i in range(300)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, size string")
    order = sorted(((-1 if d is None else d, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for d, t, _ in rows))
    total, upto, want, count = sum(x[2] for x in order), 0, [], {}
    for d, crc, size in order:
        upto += size
        shard = min(7, 8 * (2 * upto - size) // (2 * total))
        want.append((d, size, crc, shard, count.setdefault(shard, 0)))
        count[shard] += 1
    got = sorted(((-1 if x.doc_id is None else x.doc_id), x.size, x.text_crc32, x.shard, x.slot) for x in sh.shards(df).collect())
    assert got == sorted(want)


def test_line_dedup(spark):
    passage = " ".join(prose(3, 60))
    texts = [None, "", f"one\n{passage}\ntwo", f"three\n{passage}", "short\nshort", passage, "four"]
    rows = {r.doc_id: r for r in ld.dedup_lines(docs(spark, texts)).collect()}
    assert rows[2].text == texts[2] and rows[3].text == "three" and rows[5].emptied and rows[4].text == texts[4] and rows[0].text is None
    assert sorted(r.doc_id for r in ld.line_dedup(docs(spark, texts)).collect()) == [0, 1, 2, 3, 4, 6]
    assert ld.dedup_lines(docs(spark, [])).count() == 0


def test_line_dedup_compares_bytes(spark):
    from pyspark.sql import functions as F

    r = random.Random(8)
    passages = ["\n".join(" ".join(prose(100 * i + j, 4)) for j in range(6)) for i in range(12)] + [" ".join(prose(i, 55)) for i in range(6)]
    texts = ["\n".join(r.sample(passages, 4)) for _ in range(60)]
    chunks = [c.text for c in ld._chunked(docs(spark, texts), 4, 50).orderBy("doc_id").select(F.explode("_chunks").alias("c")).where("c.whole").select("c.text").collect()]
    assert len(chunks) > 200
    extra = len(chunks) - len(set(chunks))
    for hashed in (F.xxhash64, F.length, lambda c: F.lit(1)):  # the last two make chunks collide
        gone = {x.doc_id: sorted(x._gone) for x in ld.repeats(docs(spark, texts), hashed=hashed).collect()}
        assert sum(map(len, gone.values())) == extra
        seen, want = set(), {}
        for row in ld._chunked(docs(spark, texts), 4, 50).orderBy("doc_id").collect():
            for pos, c in enumerate(row._chunks):
                if c.whole and c.text in seen:
                    want.setdefault(row.doc_id, []).append(pos)
                seen.add(c.text)
        assert gone == want


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_short_runs_in_any_surroundings(spark, seed):
    r = random.Random(seed)
    passages = [[" ".join(prose(1000 * seed + 10 * i + j, 12 if n > 4 else 30)) for j in range(n)] for i, n in enumerate((2, 3, 4, 5, 6))]
    texts = [""]
    for k in range(40):
        own = lambda j: [" ".join(prose(10**6 + 100 * k + j + i, 7)) for i in range(r.randrange(4))]  # noqa: B023, E731
        texts.append("\n".join([*own(0), *r.choice(passages), *own(10), *r.choice(["", " \n"]).split("\n"), *own(20)]))
    texts += ["a\na\na", "b\nb\nb\nb\nb", "k\n\nl\nk\n\nl\nk\nl", "\n".join(passages[0][:1] + ["x"])]

    def blank(x):
        return not x.strip(" \t\n\x0b\x0c\r")

    earlier, want = {}, {}  # every run of two lines or more, and of 50 words, is looked up as it is
    for d, t in enumerate(texts):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines)):
            for j in range(i, min(i + 12, len(lines))):
                run = lines[i : j + 1]
                if blank(run[0]) or blank(run[-1]) or (sum(not blank(x) for x in run) < 2 and len(run[0].split()) < 50):
                    continue
                first = earlier.setdefault("\n".join(run), (d, j))
                if first[0] < d or first[1] < i:
                    gone |= set(range(i, j + 1))
        left = [x for i, x in enumerate(lines) if i not in gone]
        want[d] = (t, False) if not gone else ("\n".join(left), False) if not all(map(blank, left)) else ("", True)
    got = {x.doc_id: (x.text, x.emptied) for x in ld.dedup_lines(docs(spark, texts)).collect()}
    assert got == want
    assert sum(got[d][0] != t for d, t in enumerate(texts)) >= 35


def test_html(spark):
    page = '<html><body><nav><a href="/">Menu</a></nav><div class="ad">Buy</div><article><h1>T &amp; x</h1><p>A  b<br>c<p>D <b>e</b><div class="comments"><p>no</p></div><form>f</form></article><footer>F</footer><script>var x="</p>"</script></body></html>'
    pages = spark.createDataFrame([(0, "http://a.example/x", page), (1, None, None), (2, "x", "<p>only"), (3, "http://a.example/y", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in he.main_text(pages).collect()}
    assert rows[0].text == "T & x\n\nA b c\n\nD e" and rows[0].n_chars == len(rows[0].text)
    assert rows[1].text == "" and rows[2].text == "only" and rows[3].text == ""
    assert he.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    [
        "<div class=content><h1>Top</h1><p>lead</p><div class=section>{0}</div><div class=section>{1}</div></div>",
        "<div class=content><h1>Top</h1><p>lead</p><table><tr><td>{0}</td><td>{1}</td></tr></table></div>",
        "<article><header><h1>Top</h1></header><p>lead</p><div><div>{0}</div><div>{1}</div></div></article>",
    ],
)
def test_html_keeps_what_is_around_the_winner(page):
    a, b = " ".join(prose(1, 70)), " ".join(prose(2, 70))
    source = "<html><body><nav>Menu</nav>" + page.format(a, b) + "<footer>F</footer></body></html>"
    path = he.votes(source)[0][0]
    assert he.extract(source, path) == "\n\n".join(["Top", "lead", a, b])


def test_html_hints_and_headers():
    body = "<html><body>{0}<article><div class='entry-header'><h1>Title</h1><p>by me</p></div><p>para</p><div class='left-side'><p>real</p></div><div class='market-share'><a href=x>{1}</a></div>{2}</article></body></html>"
    page = body.format("<div class='page-header'><p>Site</p></div><div class='left-side'><p>Menu</p></div>", "Links and more links", "<div class='comment-list'><p>reader</p></div><div class=share>tweet</div>")
    assert he.extract(page, he.votes(page)[0][0]) == "Title\n\npara\n\nreal"


def test_html_of_any_shape_is_read_in_one_pass():
    import time

    began = time.time()
    for page in (
        "<a " * 350_000, "<a href=\"x" * 100_000, "<div>" * 100_000 + "text", "<p>" + "<b>" * 100_000 + "text" + "</i>" * 100_000, "<div>t" * 60_000, "<tr>" * 100_000, "<!" * 300_000,
        "<div>" * 600 + "<tr></tr></ul>" * 30_000 + "text", "&" * 300_000, "<script>" * 100_000, "<a><div>" * 50_000 + "</a>" * 50_000 + "t",
    ):
        he.votes(page)
        he.extract(page, None)
    assert time.time() - began < 60
    assert he.extract("<body>" + "<div>" * 2000 + "deep" + "</div>" * 2000 + "<p>last", None) == "deep\n\nlast"
    assert he.extract("<p>x <a " + "y" * 5, None) == "x <a yyyyy"


def test_url_filter(spark):
    link = '<link rel="canonical" href="/es/1">'
    rows = [
        (0, "http://X.example.org/es/1", None), (1, "https://alias.example.net/p?utm_source=a#f", '<meta http-equiv="refresh" content="0; url=http://x.example.org/es/1">'),
        (2, "http://alias.example.net/p/", None), (3, "http://other.example.net/q", None), (4, None, None), (5, "nohost", None), (6, "http://x.example.org/fine", link), (7, "http://a.com/de/", None),
    ]
    got = {r.page_id: r for r in uf.url_filter(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("x.example.org", "/es/1", "example.org/es/", "block")
    assert got[6].rule == "org/" and got[6].verdict == "allow" and got[7].verdict == "block"
    assert got[1].verdict == "allow" and got[2].verdict == "allow"  # the component holds an explicitly allowed url
    only = [r for r in rows if r[0] != 6]
    got = {r.page_id: r for r in uf.url_filter(spark.createDataFrame(only, "page_id long, url string, html string")).collect()}
    assert got[1].verdict == "block" and got[2].verdict == "block" and got[3].verdict == "allow" and got[4].host == "" and got[5].verdict == "allow"


def test_url_references_are_resolved(spark):
    cases = [
        ("http://h/a/b.html", "c.html", "h/a/c.html"), ("http://h/a/b/", "../x", "h/a/x"), ("http://h/a/b?q=1", "?p=2", "h/a/b?p=2"), ("http://h/a/b#f", "#top", "h/a/b"),
        ("https://h", "x", "h/x"), ("http://h/a/b", "//o/x", "o/x"), ("http://h/a/b", "/x/./y/../z", "h/x/z"), ("http://h/a", "http://h/p?a=1&amp;b=2", "h/p?a=1&b=2"),
        ("http://h/a", "/&#112;&#x71;&#38;amp;", "h/pq&amp;"), ("http://h/a/b", "../../../x/..", "h"), ("http://h/a", "mailto:x@y", None), ("nohost", "x", None), (None, "http://h/x", None),
    ]
    for link in ("<link data-href='/no' rel=\"canonical\" href=\"{}\">", "<meta http-equiv=refresh content='0; URL={}'>", "<META content=\"5;url='{}'\" HTTP-EQUIV='Refresh'>"):
        pages = spark.createDataFrame([(u, "<p>canonical" + link.format(r)) for u, r, _ in cases], "url string, html string")
        assert sorted(x.b for x in uf.links(pages).collect()) == sorted(b for _, _, b in cases if b), link
    based = spark.createDataFrame([("http://h/a/b", '<base href="/deep/er/"><link rel="alternate canonical" href=x>'), ("http://h/a", "<link " * 50_000 + "canonical")], "url string, html string")
    assert [(x.a, x.b) for x in uf.links(based).collect()] == [("h/a/b", "h/deep/er/x")]


def test_url_aliases_equal_union_find(spark):
    r = random.Random(3)
    names = [f"http://{h}/p{i}" for h in ("a.de.com", "b.org", "c.example.net", "d.example.org") for i in range(300)] + [f"http://x.com/de/{i}" for i in range(100)] + [f"http://x.com/fr/{i}" for i in range(20)]
    links = [(r.choice(names), r.choice(names)) for _ in range(500)] + [(names[600], n) for n in names[601:700]]  # a hub
    given = links[:250]
    html = {}
    for a, b in links[250:]:
        html.setdefault(a, []).append(f'<link rel="canonical" href="{b}">')
    rows = [(i, n, "".join(html.get(n, [])) or None, 7) for i, n in enumerate(names)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, alias int")  # a clashing name
    up = {n: n for n in names}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[find(a)] = find(b)
    got = {x.page_id: x for x in uf.url_filter(pages, redirects=spark.createDataFrame(given, "f string, t string")).collect()}
    verdicts = {i: "allow" if ".org/p" in n or "/fr/" in n else "block" if "/de/" in n else None for i, n in enumerate(names)}
    groups = {}
    for i, n in enumerate(names):
        groups.setdefault(find(n), set()).add(verdicts[i])
    want = {i: verdicts[i] or ("block" if "block" in groups[find(n)] and "allow" not in groups[find(n)] else "allow") for i, n in enumerate(names)}
    assert {i: x.verdict for i, x in got.items()} == want
    spread = sum(want[i] == "block" and verdicts[i] is None for i in want)
    assert spread > 10
    assert uf.url_filter(pages.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "http://H.org/" + "x" * 200_000, None), (1, "http://H.org/" + "x" * 200_000, None)], "page_id long, url string, html string")
    assert [(x.rule, len(x.path)) for x in uf.url_filter(long).collect()] == [("org/", 200_001)] * 2


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(1, None)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}


@pytest.mark.parametrize("size", [100_000, 60])
def test_components_from_stars_of_tasks(spark, monkeypatch, size):
    monkeypatch.setattr("sigspark.llm.common.ROWS_A_TASK", size)  # one task and no rounds, or several and rounds over their stars
    r = random.Random(size)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i + 1, i) for i in range(1000, 1040)] + [(1, None), (None, None), (5000, 5000)]
    edges += [(2000, i) for i in range(2001, 2050)] * 2
    least = {i: i for e in edges if None not in e and e[0] != e[1] for i in e}
    while any(least[a] != least[b] for a, b in edges if a in least and b in least):
        for a, b in edges:
            if a in least and b in least:
                least[a] = least[b] = min(least[a], least[b])
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), native=False).collect()
    assert len(got) == len(least) and {x.node: x.component for x in got} == least
    assert connected_components(spark.createDataFrame([], "a long, b long"), native=False).count() == 0


def test_near_dedup_of_a_chain_leaves_few_jobs_in_the_driver(spark):
    words = prose(3, 120)
    texts = [" ".join([*words[: 120 - 3 * i], *prose(50 + i, 3 * i)]) for i in range(40)]
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    before = jobs()
    rows = nd.components(docs(spark, texts), k=3, percent=85).collect()
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, w in enumerate(t.split() for t in texts)}
    assert {x.doc_id: x.component_id for x in rows} == _components(sets, 85)
    assert jobs() - before < 80  # 101 with rounds over a graph that fits one task


def test_piece_codec(spark):
    pieces = pc.load()
    codec = pc.Codec(pieces)
    texts = ["", "a  b   c", "  lead", "日本語 x😀y", "tab\tnew\nline", "w" * 3000, " ".join(prose(1, 50))]
    for t, data in zip(texts, codec.encode_batch(texts)):
        assert codec.decode(np.frombuffer(data, "<u4")) == t
    whole, pc.SLICE = codec.encode_batch([None, *texts]), 5
    assert pc.Codec(pieces).encode_batch([None, *texts]) == whole
    pc.SLICE = 1 << 19

    def best(part):  # every path
        b, n = part.encode(), len(part.encode())
        score = [0.0] + [float("-inf")] * n
        known = {pieces.texts[i].encode(): pieces.scores[i] for i in range(len(pieces.texts)) if pieces.kinds[i] in (1, 4)}
        for j in range(1, n + 1):
            for i in range(j):
                s = known.get(b[i:j])
                if s is None and len(b[i:j].decode("utf-8", "ignore").encode()) == j - i and len(b[i:j].decode("utf-8", "ignore")) == 1:
                    s = pieces.unknown_score
                if s is not None:
                    score[j] = max(score[j], score[i] + s)
        return score[n]

    for part in ["▁hello", "▁w123x", "▁thing", "▁x😀"]:
        ids = np.frombuffer(pc.segment(pieces, [part.encode()])[0], "<u4")
        raw = sum(pieces.kinds[i] == pc.BYTE for i in ids)
        chars = sum(1 for c in part if len(c.encode()) == 4)
        got = sum(pieces.scores[i] for i in ids if pieces.kinds[i] != pc.BYTE) + (chars if raw else 0) * pieces.unknown_score
        assert got == pytest.approx(best(part))
    rows = {r.doc_id: r for r in pc.encode(docs(spark, [None, "", "a b", "▁"])).select("doc_id", "_piece.*").collect()}
    assert rows[0].n_tokens == 0 and rows[2].lossless and not rows[3].lossless
    long = " ".join(prose(5, 60_000))
    got = pc.encode(docs(spark, [long, long, "a b", "a b"]).withColumnRenamed("_w", "n_tokens")).select("doc_id", "_piece.*").orderBy("doc_id").collect()
    assert got[0].ids == got[1].ids and got[2].ids == got[3].ids and all(x.lossless for x in got) and got[0].n_tokens > 60_000
    assert pc.encode(docs(spark, [])).count() == 0


def test_token_store(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(ts.default_tokenizer())
    texts = [None, "", "It's a TEST... don't!? 12ab3 <|endoftext|> x", "Ünïcode ÀÉÎ, ß İ 日本", *[" ".join(prose(i, 40)) for i in range(60)]]
    ts.write_tokens(docs(spark, texts), str(tmp_path / "t"), block_bytes=2000)
    rows = sorted(ts.read_index(spark, str(tmp_path / "t")).collect(), key=lambda r: r.doc_id)
    start = 0
    for text, r in zip(texts, rows, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert ts.read_document(spark, str(tmp_path / "t"), 3) == [[*t.encode(texts[3], add_special_tokens=False).ids, 2]]


def test_token_store_edges(spark, tmp_path):
    texts = [(None, "a b"), (3, None), (3, "x y"), (3, "x y"), (1, "word " * 60_000), (None, None)]
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(texts)], "doc_id long, text string, part int")
    ts.write_tokens(df, str(tmp_path / "t"), block_bytes=500)
    rows = ts.read_index(spark, str(tmp_path / "t")).collect()
    assert [x.doc_id for x in sorted(rows, key=lambda x: x.start)] == [None, None, 1, 3, 3, 3]
    upto = 0
    for x in sorted(rows, key=lambda x: x.start):
        assert x.start == upto
        upto += x.n_tokens
    ts.write_tokens(df.limit(0), str(tmp_path / "none"))
    assert ts.read_index(spark, str(tmp_path / "none")).count() == 0


def test_license_scan(spark):
    texts = [None, "", "This work is licensed under the GNU General Public License, version 3.", "Apache License; mit license MIT License", "Licensed under CC BY-NC 4.0.", "license free"]
    rows = {r.doc_id: r for r in ls.scan(docs(spark, texts)).collect()}
    assert (rows[2].n_base, rows[2].first_word, rows[2].base_labels, rows[2].labels) == (1, 6, "gpl", "gpl,gpl-3.0")
    assert (rows[3].n_base, rows[3].first_word, rows[3].last_word, rows[3].base_labels) == (3, 0, 4, "apache,mit")
    assert rows[4].labels == "cc-by,cc-by-nc-4.0" and rows[5].labels == "" and rows[0].n_words == 0 and rows[5].score == 0.0


def _scanned(text, templates, base):
    """n_words, places and labels of base phrases, all labels and the score, from the words alone."""
    w = __import__("re").findall(ls_word, (text or "").translate(str.maketrans(ls.UPPER, ls.LOWER)))
    stands = lambda p, at: at >= 0 and w[at : at + len(p)] == p
    places = [(i, label) for p, label in base for i in range(len(w)) if stands(p.split(), i)]
    labels, best = {label for _, label in places}, 0.5 if places else 0.0
    for label, t, phrases in templates:
        t = t.split()
        at = [next(k for k in range(len(t)) if t[k : k + len(p.split())] == p.split()) for p in phrases]
        for o in range(-len(t), len(w)):
            if all(stands(p.split(), o + k) for p, k in zip(phrases, at)):
                labels.add(label)
                best = max(best, sum(0 <= o + k < len(w) and w[o + k] == x for k, x in enumerate(t)) / len(t))
    spots = [i for i, _ in places]
    return len(w), len(places), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), best


ls_word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@pytest.mark.parametrize("n", [0, 500])
def test_license_scan_equals_brute_force(spark, n):
    r = random.Random(n)
    small = [f"l{i}" for i in range(40)] + ["é", "2", "0"]
    made = []
    for i in range(n):
        t = [r.choice(small) for _ in range(r.randrange(4, 14))]
        k = r.randrange(len(t) - 2)
        made.append((f"t{i % 90}", " ".join(t), [" ".join(t[k : k + 3]), *([" ".join(t[-2:])] if i % 5 == 0 else [])]))
    templates = [*ls.TEMPLATES, *made]
    texts = [None, "", "MIT", "mit-license " * 3000, "cc by " * 200 + "x" * 100_000]
    for i in range(40):
        words = [r.choice([*small, "gnu", "general", "public", "license", "cc", "by", "Mit", "Apache"]) for _ in range(r.randrange(60))]
        for _ in range(r.randrange(3)):
            label, t, phrases = r.choice(templates)
            part = t.split()
            if r.random() < 0.3:
                part[r.randrange(len(part))] = "other"
            words[r.randrange(len(words) + 1) : 0] = part[r.randrange(2) :]
        texts.append(r.choice([" ", ", ", "\n", "--"]).join(words))
    df = spark.createDataFrame([(i // 2, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, _h string, n_words int")  # clashing names, repeated ids
    got = sorted((tuple(x) for x in ls.scan(df, templates).collect()), key=repr)
    want = sorted(((i // 2, *_scanned(t, templates, ls.BASE)) for i, t in enumerate(texts)), key=repr)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert [x[-1] for x in got] == pytest.approx([x[-1] for x in want])
    assert ls.scan(df.limit(0)).count() == 0


def test_decontaminate(spark):
    item = prose(11, 40)
    edited = list(item)
    for i in (5, 13, 22, 30):
        edited[i] = "new"
    texts = [None, "", " ".join(prose(12, 200)), " ".join(prose(13, 50) + item + prose(14, 50)), " ".join(prose(15, 50) + edited), " ".join(item[:12] + prose(16, 30))]
    bench = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, "a b")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.matches(docs(spark, texts), bench).collect()}
    assert set(got) == {(3, 0), (4, 0)} and got[3, 0].score == 1.0 and (got[3, 0].first_word, got[3, 0].last_word) == (50, 89)

    def slow(a, b):
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.OFF), h[i - 1, j] + dc.OFF, h[i, j - 1] + dc.OFF)
        return h.max()

    r = random.Random(1)
    pairs = [tuple(np.array([r.randrange(4) for _ in range(r.randrange(1, 15))], np.uint64) for _ in range(2)) for _ in range(60)]
    assert [x[0] for x in dc.align(pairs)] == [slow(a, b) for a, b in pairs]
    assert dc.matches(docs(spark, []), bench).count() == 0 and dc.matches(docs(spark, texts), bench.limit(0)).count() == 0


def test_decontaminate_equals_brute_force(spark):
    """Every document aligned with every item, without seeds and windows; random everyday words around and in the items."""
    r = random.Random(6)
    small = [f"v{i}" for i in range(60)]
    items = [[r.choice(small) if r.random() < 0.5 else f"r{i}x{j}" for j in range(r.randrange(12, 70))] for i in range(12)]
    texts, n_edited = [], 0
    for k in range(60):
        item = list(items[k % 12])
        kind = k % 5
        if kind == 1:
            item = item[: max(26, len(item) // 3)]  # an excerpt
        if kind in (2, 3):
            n_edited += 1
            for _ in range(len(item) // (9 if kind == 2 else 6)):
                j = r.randrange(len(item))
                item[j : j + r.randrange(2)] = ["new"] * r.randrange(3)
        around = lambda: [r.choice(small) for _ in range(r.randrange(120))]
        texts.append(" ".join([*around(), *([] if kind == 4 else item), *around(), *(item if k % 7 == 0 and kind == 0 else [])]))

    def hashes(words):
        return np.array([hash(w) & 0xFFFFFFFF for w in words], np.uint64)

    pairs = {(d, i): (hashes(item), hashes(t.split())) for d, t in enumerate(texts) for i, item in enumerate(items) if t}
    want = set()
    for (d, i), (score, first, last) in zip(pairs, dc.align(list(pairs.values()))):
        span = last - first + 1
        if score >= 0.6 * 2 * len(items[i]) or span >= 25 and score >= 0.8 * 2 * span:
            want.add((d, i))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    for block in (1, 2_000_000):  # an item a block, and all in one
        got = {(x.doc_id, x.item_id) for x in dc.matches(docs(spark, texts), bench, block_words=block).collect()}
        assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 30, (got ^ want)


def test_decontaminate_many_items_and_null_ids(spark):
    rows = [dc.Items([(i, f"q{i} the of and in {i % 7} a b c d") for i in range(20_000)], 3)]
    of = np.ones(len(rows[0].gram), np.int64)
    of[::9] = 100
    keep = rows[0].rarest(of, 0.75)
    for i in (0, 7, 19_999):
        mine = np.flatnonzero(rows[0].item == i)
        limit = np.sort(of[mine])[int(np.ceil(0.75 * len(mine))) - 1]
        assert (keep[mine] == (of[mine] <= limit)).all()
    item = " ".join(prose(31, 40))
    df = spark.createDataFrame([(None, item, 1), (1, item, 2), (1, item, 3), (2, None, 4)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(0, item), (None, item), (0, item)], "item_id long, text string")
    assert sorted((str(x.doc_id), str(x.item_id)) for x in dc.matches(df, bench).collect()) == [("1", "0"), ("1", "None"), ("None", "0"), ("None", "None")]
    kept = dc.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(x.item_id for x in kept.collect()) == [1, 4]


def _quality(rows):
    """The kept rows by the fences of all documents; groups here are too small for their own."""
    counts = [qr.measure(t) for _, t in rows]
    base = [c[0] < 20 or 100 * c[5] > 30 * c[0] for c in counts]
    ratio = {k: [c[qr.METRICS.index(r[0])] * r[2] // max(c[qr.METRICS.index(r[1])], 1) for c in counts] for k, r in qr.RATIOS.items()}
    ok = [not b for b in base]
    for k, r in qr.RATIOS.items():
        bins = sorted(v - v % 10 ** max(len(str(v)) - 2, 0) for v, b in zip(ratio[k], base) if not b)
        q1, q3 = (bins[-(-len(bins) * q // 4) - 1] for q in (1, 3))
        for i, v in enumerate(ratio[k]):
            ok[i] = ok[i] and v <= q3 + 3 * (q3 - q1) + r[3] and (r[4] is None or v >= q1 - 3 * (q3 - q1) - r[4])
    return [x for x, o in zip(rows, ok) if o]


def _lines(rows):
    """Lines of runs of two or more, or of 50 words, that occur earlier, out; a pair beside its own first occurrence stays."""
    first, out = {}, []
    for d, t in sorted(rows):
        lines, gone = t.split("\n"), set()
        full = [i for i, x in enumerate(lines) if x.strip()]
        spans = list(zip(full, full[1:])) + [(i, i) for i in full if len(lines[i].split()) >= 50]
        for k, (i, j) in enumerate(spans):
            at = first.setdefault("\n".join(lines[i : j + 1]), (d, k))
            if at != (d, k) and not (j > i and at == (d, k - 1)):
                gone |= set(range(i, j + 1))
        left = [x for i, x in enumerate(lines) if i not in gone]
        if not gone or any(x.strip() for x in left):
            out.append((d, "\n".join(left)))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(12)
    text = lambda seed, n=90: "\n".join(" ".join(prose(seed * 10 + j, n // 3)) for j in range(3))
    texts = [text(100 + i) for i in range(60)]
    items = [" ".join(prose(900 + i, 40)) for i in range(6)]
    texts += [f"{text(300 + i, 30)}\n{items[i]}\n{text(400 + i, 30)}" for i in range(5)]  # leaked
    for i in range(10):  # near copies of one text each
        w = texts[i].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    shared = "\n".join(" ".join(prose(700 + j, 25)) for j in range(3))
    texts += [f"{text(500 + i)}\n{shared}\n{text(600 + i)}" for i in range(4)]
    texts += [texts[3], texts[3], None, "", "too short", " ".join(["again and again"] * 40), "# * $ % " * 40, text(800, 60_000)]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), "x") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _m string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate([*items, None])), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = _lines(_quality([(i, t) for i, t in enumerate(texts)]))
    group = _components({d: _shingles(t.lower(), 5) for d, t in left}, 80)
    left = [(d, t) for d, t in left if group[d] == d]

    def leaked(t):
        pairs = [tuple(np.array([zlib.crc32(x) for x in dc.words_of(y)], np.uint64) for y in (item, t)) for item in items]
        found = [(s, b - a + 1, len(p[0])) for (s, a, b), p in zip(dc.align(pairs), pairs)]
        return any(s >= 1.2 * n or span >= 25 and s >= 1.6 * span for s, span, n in found)

    want = {d: t for d, t in left if not leaked(t)}
    assert set(got) == set(want) and 60 < len(want) < len(texts)
    codec = pc.Codec(pc.load())
    assert {d: list(x.ids) for d, x in got.items()} == {d: np.frombuffer(codec.encode_batch([t])[0], "<u4").tolist() for d, t in want.items()}
    assert all(codec.decode(np.array(x.ids)) == want[d] and x.lossless for d, x in got.items())


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "lang", "source"]
