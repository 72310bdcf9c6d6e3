import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sigspark import schema as S
from sigspark.builder import RuleBuilder
from sigspark.functions.cost import rule_cost
from sigspark.functions.printer import rule_text
from sigspark.operators import similarity as M
from sigspark.operators.parse import parse
from sigspark.operators.selectors import Q, parse_selector, query
from sigspark.plugins import PluginError, Registry
from sigspark.sources.readers import assemble, from_texts, guard_path, parse_file, read_rules
from sigspark.sources.writers import schema_text

GOOD = (
    'alert tcp $HOME_NET any -> [10.0.0.0/24,![1.2.3.4,fe80::1]] [80,443,1000:] (msg:"a;b \\"q\\" (x)"; flow:established,to_server; content:"GET|20|/x"; nocase; depth:5; '
    'content:"|FF 00|",offset 3,nocase; pcre:"/a;b\\/c/i"; reference:url,example.com/a; metadata:k v, x y z; flowbits:set,a.b; classtype:trojan-activity; priority:2; sid:1; rev:3;)'
)
BAD = [
    'alert tcp any any -> any any (msg:"x" sid:1;)', "alert tcp any any -> any 99999 (sid:1;)", 'alert tcp any any -> any any (msg:"x"; sid:1;', "alert tcp any any any any (sid:1;)",
    "alert foo any any -> any any (sid:1;)", "noise tcp any any -> any any (sid:1;)", "alert tcp any any -> any any (sid:-1;)", "alert tcp any any -> any any (priority:10;)",
    "alert tcp any any -> any any (content:|ZZ ZZ|; sid:1;)", 'alert tcp any any -> any any (pcre:"/abc)', "alert tcp any any -> any 8080:80 (sid:1;)",
]


def test_parse_and_print(spark):
    rules = from_texts(spark, [GOOD, *BAD, 'alert http (msg:"m"; http.uri; content:"x"; sid:5;)'])
    rows = {r["index"]: r for r in rules.collect()}
    good = rows[0]
    assert good.ok and good.msg == 'a;b "q" (x)' and good.sid == 1
    assert [(a.node_type, a.negated) for a in good.dst_addr.atoms] == [("IPCIDRRange", False), ("IPAddress", True), ("IPAddress", True)]
    assert [(a.value, a.start, a.end) for a in good.dst_port.atoms] == [(80, None, None), (443, None, None), (None, 1000, 65535)]
    assert [bytes(o.pattern) for o in good.options if o.pattern] == [b"GET /x", b"\xff\x00"]
    assert all(not rows[i + 1].ok and rows[i + 1].protocol == "ip" and rows[i + 1].diagnostics[0].code == "PARSE_ERROR" for i in range(len(BAD)))
    assert rows[len(BAD) + 1].ok and rows[len(BAD) + 1].src_addr.text == "any"
    plain = GOOD.replace(' \\"q\\"', "")  # a message is printed as it is, so quotes in it do not come back
    text = from_texts(spark, [plain]).select(rule_text().alias("t")).first().t
    assert 'msg:"a;b (x)"' in text
    assert from_texts(spark, [text]).select(rule_text().alias("t")).first().t == text


def test_cost_fold(spark):
    rule = 'alert tcp any any -> any any (content:"abcdef"; depth:5; pcre:"/a.*b|c/i"; sid:1;)'
    assert from_texts(spark, [rule]).select(rule_cost().alias("c")).first().c == pytest.approx(10 - 1 + 100 * 1.4 * 1.1 * 1.3 + 0.1)


@pytest.mark.parametrize(
    ("selector", "types"),
    [
        ("MsgOption + FlowOption", ["FlowOption"]), ("ContentOption ~ SidOption", ["SidOption"]), ("Rule > Header > IPCIDRRange", ["IPCIDRRange"]),
        ("Header ContentOption", []), ("SidOption, MsgOption", ["SidOption", "MsgOption"]), ("Rule:has(LuaOption)", []), ("Header:has(PortRange)", ["Header"]),
        ("PriorityOption[value > 1]", ["PriorityOption"]), ("FlowOption:empty", []), ("MsgOption:first-child", ["MsgOption"]), ("AddressList", []), ("SidOption:nth(2)", []),
    ],
)
def test_selectors(spark, selector, types):
    assert [r.node_type for r in query(from_texts(spark, [GOOD]), selector).orderBy("rank").collect()] == types


def test_selector_errors():
    for text in ("", "A[", "A[b=", "A >", "A)"):
        with pytest.raises(S.QuerySyntaxError):
            parse_selector(text)
    with pytest.raises(S.InvalidSelectorError):
        parse_selector("A:nosuch")
    assert Q("SidOption").attr("value", "=", 1).child_of("Rule").text == 'Rule > SidOption[value="1"]'


def test_minhash_forms_agree(spark):
    df = spark.createDataFrame([(1, ["a", "b", "é"]), (2, []), (3, ["a", "b"])], "id long, f array<string>")
    fast = {r.id: r.sig for r in M.signatures(df, "id", "f", n=16).collect()}
    assert fast == {r.id: r.sig for r in M.signature_column(df, "f", n=16).collect()} and fast[2] == [0] * 16


def test_assembly_and_files(spark, tmp_path):
    text = '# note\nalert tcp any any -> any any (\n  msg:"a";\n# inside\n sid:1;)\n\ndrop udp any any -> any any (msg:"b"; sid:2;)\nalert tcp any any -> any any (msg:"c";\nalert ip any any -> any any (sid:4;)\n'
    (tmp_path / "a.rules").write_text(text)
    rules = {r.start_line: r for r in read_rules(spark, str(tmp_path / "a.rules"), multiline=True).collect()}
    assert {k: (r.end_line, r.ok, r.sid) for k, r in rules.items()} == {2: (5, True, 1), 7: (7, True, 2), 8: (8, False, None), 9: (9, True, 4)}
    with pytest.raises(ValueError):
        guard_path("/etc/hosts", allowed_base=str(tmp_path))
    with pytest.raises(ValueError):
        read_rules(spark, "/etc/hosts", allowed_base=str(tmp_path))
    (tmp_path / "bad.rules").write_text("nonsense\nmore\n")
    with pytest.raises(S.ParseError):
        parse_file(spark, str(tmp_path / "bad.rules"))
    assert parse_file(spark, str(tmp_path / "a.rules"), multiline=True).count() == 4
    assert '"options"' in schema_text(from_texts(spark, [GOOD]))
    assert assemble(spark.createDataFrame([], "file_path string, line_no int, text string")).count() == 0


def test_builder_and_plugins(spark):
    text = RuleBuilder().alert().tcp().source().to("$HOME_NET", 80).msg('say "x"').content(b"\xffa", nocase=True).sid(7).rev(2).build()
    row = from_texts(spark, [text]).first()
    assert row.ok and row.msg == 'say "x"' and bytes(row.options[1].pattern) == b"\xffa"
    with pytest.raises(S.BuilderError):
        RuleBuilder().alert().build()
    r = Registry()
    r.register("analysis", "x", len)
    with pytest.raises(PluginError):
        r.register("analysis", "x", len)
    assert r.names("analysis") == ["x"]


@pytest.mark.parametrize("name", ["sel_attr_cmp", "sel_has", "port_coverage", "cost_total", "validate_missing", "print_rule", "minhash_sig", "line_assembly"])
def test_against_sql(spark, name):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{d}/events.parquet'")
    got = entry.queries()[name](spark, d)
    cols = sorted(got.columns)
    want = con.sql(entry.oracle_sql()[name]).df()[cols].astype(str).sort_values(cols).reset_index(drop=True)
    have = got.toPandas()[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert have.equals(want)


def test_conflicts_cover_all_rules(spark):
    import hashlib
    from collections import Counter

    import __spark_entry__ as entry
    from sigspark.plans.bridge import rules_from_events

    d = "/root/testdata/sf0.001"
    want = Counter()
    for r in rules_from_events(spark, d).collect():
        body = ";".join(sorted(o.raw for o in r.options if o.node_type not in S.METADATA_TYPES))
        sig = "|".join([r.protocol, r.src_addr.text, r.src_port.text, r.direction, r.dst_addr.text, r.dst_port.text, body])
        want[hashlib.sha256(sig.encode()).hexdigest()] += 2
    got = {r.signature: r.rules for r in entry.queries()["conflicting_action"](spark, d).collect()}
    assert got == want and sum(got.values()) == 2 * rules_from_events(spark, d).count()


def test_shadowed_rules_cover_all_rules(spark):
    import __spark_entry__ as entry
    from sigspark.plans.bridge import rules_from_events

    d = "/root/testdata/sf0.001"
    rules = rules_from_events(spark, d).select("id", "protocol", "direction", "dst_port.atoms").collect()
    want = {}
    for g in rules:
        for lo, hi in [(a.start, a.end) for a in g.atoms if a.node_type == "PortRange" and not a.negated]:
            for s in rules:
                if s.id != g.id and (s.protocol, s.direction) == (g.protocol, g.direction):
                    if any(a.node_type == "Port" and not a.negated and lo <= a.value <= hi for a in s.atoms):
                        want.setdefault(g.id, set()).add(s.id)
    got = {r.general: (r.rules, r.first_specific) for r in entry.queries()["shadowed_rules"](spark, d).collect()}
    assert got == {g: (len(v), min(v)) for g, v in want.items()} and len(got) > 5


def test_confirmed_pairs_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(4)
    rows = []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(40)]
        for _ in range(8):
            w = list(base)
            for _ in range(r.randrange(8)):
                w[r.randrange(40)] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), w))
    rows += [(len(rows) + i, rows[i][1]) for i in range(5)]
    rows.append((len(rows), []))
    reps, want = {}, set()
    for i, w in rows:
        if w and reps.setdefault(frozenset(w), i) != i:
            want.add((reps[frozenset(w)], i, 1.0))
    for (a, i), (b, j) in itertools.combinations(reps.items(), 2):
        if len(a & b) / len(a | b) >= 0.8:
            want.add((i, j, len(a & b) / len(a | b)))
    df = spark.createDataFrame(rows, "id long, f array<string>")
    assert {tuple(x) for x in M.confirmed_pairs(df, "id", "f").collect()} == want
    sigs = M.signatures(df.where("size(f) > 0"), "id", "f")
    members = M.membership(sigs)
    assert {(x.rep, x.id) for x in members.collect() if x.rep != x.id} == {(a, b) for a, b, s in want if s == 1.0}
    assert members.count() == len(rows) - 1


def test_similarity_queries_return_copies(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    texts = {}
    for x in spark.read.parquet(f"{d}/documents.parquet").orderBy("doc_id").collect():
        if x.text:
            texts.setdefault(x.text.lower(), []).append(x.doc_id)
    got = {(x.id_a, x.id_b) for x in entry.queries()["doc_near_duplicates"](spark, d).collect()}
    copies = [(v[0], i) for v in texts.values() for i in v[1:]]
    assert copies and {b for _, b in copies} <= {b for _, b in got}


def test_every_query_against_its_sql(spark):
    """All registered queries of the engine at the smallest scale; those without SQL must run."""
    from sigspark.plans import catalogue

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "documents"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name, run in catalogue.QUERIES.items():
        got = run(spark, d)
        rows = got.toPandas()
        if name not in catalogue.ORACLES:
            assert len(rows) > 0, name
            continue
        cols = sorted(got.columns)
        want = con.sql(catalogue.ORACLES[name]).df()
        assert sorted(want.columns) == cols, name
        shown = lambda df: sorted(tuple("" if v is None or v is pd.NA or v != v else f"{v:.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[cols].astype(object).values.tolist())  # noqa: B023, E731
        assert shown(rows) == shown(want), name


def test_rules_of_any_length(spark):
    long = 'alert tcp any any -> any any (msg:"{}"; sid:1;)'
    listed = "alert tcp [" + ",".join(f"10.{i // 250}.{i % 250}.1" for i in range(5000)) + "] ![80,![81,82]] -> any any (sid:2;)"
    many = "alert tcp any any -> any any (" + " ".join(f'content:"c{i}";' for i in range(998)) + " sid:3;)"
    texts = [long.format("x" * 99_900), listed, many, many.replace(" sid:3", ' content:"x"; content:"y"; sid:3'), long.format("x" * 100_000), long.format("\\\\a" * 20_000), "alert tcp [" + "[" * 40_000, "alert tcp any any -> any any (" + '"' * 50_001]
    rows = {r["index"]: r for r in from_texts(spark, texts).collect()}
    assert rows[0].ok and len(rows[0].msg) == 99_900
    assert rows[1].ok and len(rows[1].src_addr.atoms) == 5000 and [(a.value, a.negated) for a in rows[1].src_port.atoms] == [(80, True), (81, False), (82, False)]
    assert rows[2].ok and len(rows[2].options) == 999 and not rows[3].ok and rows[3].diagnostics[0].message == "too many options"
    assert rows[4].diagnostics[0].message == "rule is longer than the limit" and rows[5].ok and not rows[6].ok and not rows[7].ok


def test_comma_parts_options(spark):
    texts = [
        'alert tcp any any -> any any (msg:"a, sid:9", sid:1)', 'alert tcp any any -> any any (content:"x",depth 3,nocase, metadata:k v, x y; sid:2)',
        'alert tcp any any -> any any (reference:url,example.com/a:1, rev:2, sid:3;)',
    ]
    rows = {r.sid: r for r in from_texts(spark, texts).collect()}
    assert rows[1].msg == "a, sid:9" and len(rows[1].options) == 2
    assert [m.name for m in rows[2].options[0].modifiers] == ["depth", "nocase"] and [(e.key, e.value) for e in rows[2].options[1].entries] == [("k", "v"), ("x", "y")]
    assert rows[3].options[0].ref_id == "example.com/a:1" and rows[3].options[1].value_int == 2


def test_coverage_report(spark):
    from sigspark.operators import analysis as A
    from sigspark.operators.reports import report
    from sigspark.plans.bridge import rules_from_events

    rules = rules_from_events(spark, "/root/testdata/sf0.001").cache()
    got = report(rules)
    assert got.counts["port"] == {str(r.port): r.rules for r in A.port_coverage(rules).collect()}
    assert got.counts["content_type"] == {r.content_type: r.cnt for r in A.content_types(rules).collect()}
    assert got.total == rules.count() and sum(got.counts["action"].values()) == got.total
    assert {(g["gap_type"], g["severity"]) for g in got.gaps()} == {(r.gap_type, r.severity) for r in A.gaps(rules).collect()}
    assert len(got.gaps()) == A.gaps(rules).count()
    assert "## Gaps" in got.to_markdown() and "uncovered" in got.to_text() and got.to_dict()["total_rules"] == got.total
    nothing = report(rules.limit(0))
    assert nothing.total == 0 and nothing.gaps() == [] and nothing.to_text()


def test_overlapping_contents_equal_brute_force(spark):
    import itertools
    import random

    from sigspark.operators.conflicts import all_conflicts, at_least, index, overlapping_contents

    r = random.Random(3)
    texts, sets = [], {}
    for i in range(1, 120):
        p = sorted({f"p{min(r.randrange(12), r.randrange(12))}" for _ in range(r.randrange(1, 8))})
        port = r.choice([80, 443])
        sets[i] = (port, frozenset(p))
        texts.append(f"alert tcp any any -> any {port} (" + " ".join(f'content:"{x}";' for x in p) + f" sid:{i};)")
    rules = from_texts(spark, texts)
    want, reps = set(), {}
    for i, s in sets.items():
        if reps.setdefault(s, i) != i:
            want.add((reps[s], i, 1.0))
    for (a, i), (b, j) in itertools.combinations(reps.items(), 2):
        if a[0] == b[0] and len(a[1] & b[1]) / len(a[1] | b[1]) > 0.75:
            want.add((i, j, len(a[1] & b[1]) / len(a[1] | b[1])))
    assert {tuple(x) for x in overlapping_contents(rules).collect()} == want and len(want) > 20
    found = all_conflicts(rules)
    assert found.where("kind = 'overlapping'").count() == len(want) and at_least(found, "high").count() == 0
    assert {k: v.count() > 0 for k, v in index(rules).items()} == {"by_sid": True, "by_header": True, "by_pattern": True, "by_action": True, "by_protocol": True, "setters": False, "checkers": False}


def test_builders_envelopes_records_and_index(spark):
    from sigspark.operators.optimize import optimize, records
    from sigspark.sources.readers import assemble_legacy, from_envelopes
    from sigspark.sources.writers import envelope, envelopes

    made = RuleBuilder().alert().tcp().source().to("any", 80).msg("x")
    made.content_builder().http_uri().pattern(b"GET").nocase().depth(10).done().flow_builder().to_server().established().done()
    text = made.threshold_builder().threshold_type("limit").track("by_src").count(1).seconds(60).done().sid(5).build()
    row = from_texts(spark, [text]).first()
    assert row.ok and [o.keyword for o in row.options] == ["msg", "http_uri", "content", "nocase", "depth", "flow", "threshold", "sid"]
    for bad in (lambda b: b.content_builder().done(), lambda b: b.flow_builder().done(), lambda b: b.threshold_builder().count(1).done(), lambda b: b.flow("sideways"), lambda b: b.threshold_builder().count(0)):
        with pytest.raises(S.BuilderError):
            bad(RuleBuilder())
    rules = from_texts(spark, [GOOD, text, GOOD.replace("sid:1", "sid:9")])
    packed = envelopes(rules, "index", 2)
    assert [x["count"] for x in packed.selectExpr("from_json(json, 'count int') as c", "batch").orderBy("batch").select("c.count").collect()] == [2, 1]
    back = from_envelopes(packed, "json", rules)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rules.collect()))
    assert from_envelopes(rules.select(envelope(rules).alias("j")), "j", rules).count() == 3
    with pytest.raises(Exception, match="unknown version"):
        from_envelopes(spark.createDataFrame([('{"ast_version":"2.0.0"}',)], "j string"), "j", rules).collect()
    done = records(optimize(from_texts(spark, ['alert tcp any any -> any any (sid:1; content:"abcd"; content:"efghij";)']))).first()
    assert [x.strategy for x in done.records] == done.strategies and done.records[0].before != done.records[0].after and done.records[0].details["options_before"] == 3
    sigs = spark.createDataFrame([(1, [1] * 128), (2, [2] * 128)], "id long, sig array<long>")
    lsh = M.LshIndex(sigs).add(spark.createDataFrame([(2, [3] * 128), (3, [1] * 128)], "id long, sig array<long>"))
    assert len(lsh) == 3 and len(lsh.remove(sigs.where("id = 1").select("id"))) == 2 and len(lsh.clear()) == 0
    assert {(x.query_id, x.id) for x in lsh.search(sigs.where("id = 1")).collect()} == {(1, 1), (1, 3)}
    lines = ["alert tcp any any", "-> any any (msg:\"a\";", "sid:1;)", "odd)", "drop udp any any -> any any (sid:2;)", "# c", "tail"]
    got = assemble_legacy(spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(lines)], "file_path string, line_no int, text string"))
    assert sorted((x.start_line, x.end_line) for x in got.collect()) == [(1, 2), (3, 5), (7, 7)]


def test_command_line(spark, tmp_path, capsys):
    from sigspark.cli import main

    good = tmp_path / "a.rules"
    good.write_text('alert tcp any any -> any 80 (msg:"a"; sid:1;)\n# c\ndrop udp any any -> any 53 (msg:"b"; sid:2;)\n')
    bad = tmp_path / "b.rules"
    bad.write_text("nonsense\n")
    assert main(["parse", str(good)]) == 0 and "2 rules, 0 errors" in capsys.readouterr().out
    assert main(["parse", str(bad)]) == 1
    assert main(["fmt", str(good), "--check"]) == 0 and main(["fmt", str(good)]) == 0
    assert main(["validate", str(good), "--strict"]) == 0 and main(["validate", str(bad)]) == 1
    capsys.readouterr()
    assert main(["stats", str(good), "--format", "json"]) == 0 and '"total_rules": 2' in capsys.readouterr().out
    assert main(["stats", str(good)]) == 0 and "action" in capsys.readouterr().out
    assert main(["to-json", str(good), str(tmp_path / "j")]) == 0 and main(["from-json", str(tmp_path / "j"), str(tmp_path / "t")]) == 0
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "t")).collect()) == ['alert tcp any any -> any 80 (msg:"a"; sid:1;)', 'drop udp any any -> any 53 (msg:"b"; sid:2;)']
    assert main(["schema"]) == 0 and main(["plugins"]) == 0


def test_protobuf_round_trips(spark):
    from sigspark.plans.bridge import rules_from_events
    from sigspark.sources import protobuf as P

    texts = [
        GOOD, "drop ip [10.0.0.1-10.0.0.9,!$NET] any <> ![1.2.3.0/24,[::1,any]] [1:5,!7,$P] (lua:!a.lua; filestore:to_client,file; fast_pattern; sid:4; distance:-5; within:x; threshold:type limit; http_uri; content:\"a|3B|\";)",
    ]
    rules = from_texts(spark, texts)
    whole = P.from_protobuf(P.to_protobuf(rules, "index"), "data")
    shown = lambda df: sorted(map(repr, df.select("action", "protocol", "direction", "dialect", "src_addr", "src_port", "dst_addr", "dst_port", "options", "raw_text").collect()))
    assert shown(whole) == shown(rules)
    bare = P.from_protobuf(P.to_protobuf(rules, "index", with_raw=False), "data").orderBy("key").collect()
    for a, b in zip(rules.orderBy("index").collect(), bare):
        assert b.ok and [o.asDict() | {"raw": ""} for o in b.options] == [o.asDict() | {"raw": ""} for o in a.options]
        assert (a.src_addr, a.src_port, a.dst_addr, a.dst_port, a.action, a.protocol) == (b.src_addr, b.src_port, b.dst_addr, b.dst_port, b.action, b.protocol)
    events = rules_from_events(spark, "/root/testdata/sf0.001")
    packed = P.to_protobuf_batches(events, "id", 100)
    back = P.from_protobuf_batches(packed, "data")
    assert back.exceptAll(events.select(*back.columns)).count() == 0 and back.count() == events.count()
    assert P.from_protobuf_batches(spark.createDataFrame([(None,), (b"",)], "data binary"), "data").count() == 0
    assert P.encode_rule({"action": "alert", "protocol": "tcp", "direction": "->", "dialect": "suricata", "src_addr": "any", "src_port": "any", "dst_addr": "any", "dst_port": "80", "options": [], "diagnostics": [], "raw_text": None}) == bytes.fromhex("0801121608011202 3a00 1a02 3200 2001 2a02 3a00 3204 0a02 0850 2001".replace(" ", ""))
    with pytest.raises(S.ParseError):
        P.decode_rule(b"\x12\x50a")


def test_option_locations(spark):
    from sigspark.operators.parse import locations

    text = 'alert tcp any any -> any any (msg:"a;b";\n  flow:established;;content:"x, sid:9",nocase, sid:3; )'
    for t in (text, GOOD):
        row = locations(from_texts(spark, [t])).first()
        raw = row.raw_text
        assert row.ok and [raw[x.offset :].startswith(o.keyword) for x, o in zip(row.locations, row.options, strict=True)] == [True] * len(row.options)
        assert all(x.line == raw[: x.offset].count("\n") + 1 and x.column == x.offset - (raw[: x.offset].rfind("\n") + 1) + 1 for x in row.locations)
    assert locations(from_texts(spark, ["nonsense"])).first().locations == []


def test_stream_with_progress(spark, tmp_path):
    from sigspark.operators.pipeline import Filter
    from sigspark.streaming.stream import run_batches, stream_rules

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.rules").write_text("alert tcp any any -> any any (sid:1;)\nnonsense\ndrop tcp any any -> any any (sid:2;)\n")
    got, seen = [], []
    run_batches(stream_rules(spark, str(tmp_path / "in")), lambda df, i: got.extend(r.sid for r in df.collect()), str(tmp_path / "c"), Filter("action = 'drop'"), lambda *x: seen.append(x)).awaitTermination()
    assert got == [2] and seen == [(0, 2, 1)]


def test_key_pairs_equal_similar_pairs(spark):
    import random

    r = random.Random(6)
    rows = [(g * 100 + i, [f"g{g}f{j}" for j in range(20)] + [f"o{g}_{i}_{j}" for j in range(r.randrange(3))]) for g in range(4) for i in range(40)]
    rows += [(5000 + i, rows[0][1]) for i in range(5)] + [(6000, []), (6001, None)]
    df = spark.createDataFrame(rows, "id long, f array<string>").repartition(3)
    sigs = M.signatures(df, "id", "f").cache()
    key = lambda x: sorted((p.id_a, p.id_b, round(p.similarity, 9)) for p in x.collect())
    keyed = M.keys(df, "id", "f").cache()
    want = key(M.similar_pairs(sigs))
    assert len(want) > 100
    for block in (7, 30, 2048):
        assert key(M.key_pairs(keyed, block=block)) == want
    assert sorted(map(tuple, M.key_members(keyed).collect())) == sorted(map(tuple, M.membership(sigs).collect()))


@pytest.mark.parametrize("name", ["similarity_pairs", "lsh_candidates"])
def test_lsh_queries_parse_once(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and len(plan) < 100_000


def test_key_pairs_and_members_broadcast_nothing(spark):
    from sigspark.functions.lineage import cut

    keyed = cut(M.keys(spark.range(60).selectExpr("id", "transform(sequence(1, 9), i -> concat('f', id % 6, '_', i)) AS f"), "id", "f"))
    found = M.with_members(M.key_pairs(keyed), M.key_members(keyed))
    assert sorted(map(tuple, found.collect())) == [(r, i, 1.0) for r in range(6) for i in range(r + 6, 60, 6)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shadowed_ports_and_counts_equal_brute_force(spark):
    import random

    from sigspark.operators import analysis as A

    r = random.Random(3)
    port = lambda: str(r.randrange(1, 400)) if r.random() < 0.6 else f"{(lo := r.randrange(1, 380))}:{lo + r.randrange(60)}"
    texts = [f"alert {r.choice(['tcp', 'udp'])} any any {r.choice(['->', '<>'])} any [{','.join(('!' if r.random() < 0.1 else '') + port() for _ in range(r.randrange(1, 4)))}] (sid:{r.randrange(1, 150)};)" for _ in range(200)]
    texts += ["alert tcp any any -> any any (rev:1;)", "alert udp any any <- any [50:60,55] (sid:900;)", "alert udp any any <- any 57 (sid:901;)"]
    rules = from_texts(spark, texts).where("ok").cache()
    rows, want = rules.select("sid", "protocol", "direction", "dst_port.atoms").collect(), set()
    for g in rows:
        for x in [a for a in g.atoms if a.node_type == "PortRange" and not a.negated]:
            for s in rows:
                if None not in (g.sid, s.sid) and s.sid != g.sid and (s.protocol, s.direction) == (g.protocol, g.direction) and any(a.node_type == "Port" and not a.negated and x.start <= a.value <= x.end for a in s.atoms):
                    want.add((g.sid, s.sid))
    pairs = A.shadowed_ports(rules, block=3)
    got = [tuple(p) for p in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    least = {}
    for g, s in want:
        least.setdefault(g, []).append(s)
    assert {c.general: (c.rules, c.first_specific) for c in A.shadowed_counts(rules).collect()} == {g: (len(v), min(v)) for g, v in least.items()}
    assert (900 in least) and least[900] == [901]


def test_shadowed_pairs_leave_before_their_block_is_formed(spark):
    from sigspark.operators import analysis as A

    texts = [f"alert tcp any any -> any {'80:90' if i % 2 else '85'} (sid:{i + 1};)" for i in range(400)]
    one = A.shadowed_ports(from_texts(spark, texts)).limit(1)
    plan, formed = one._jdf.queryExecution(), []
    assert len(plan.executedPlan().executeCollectPublic()) == 1

    def walk(node):
        if node.nodeName() == "Generate":
            formed.append(node.metrics().apply("numOutputRows").value())
        if node.nodeName() == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan.executedPlan())
    assert len(formed) == 2 and 0 < sum(formed) <= 400  # of 40,000 pairs in the block


def test_counts_equal_sizes_of_what_is_not_built(spark):
    """Short and long ways of the parser give the same: lists and options that take the first beside such that do not."""
    lists = ["any", "[10.0.0.1,10.0.0.2]", "[,10.0.0.1,,fe80::1,]", "[]", "[10.0.0.1 10.0.0.2]", "[10.0.0.0/24,10.0.0.1]", "![10.0.0.1,[10.0.0.2,!10.0.0.3]]", "[10.0.0.1,x!]"]
    bodies = ['msg:"a b"; content:"x";content:"y"; ; sid:1;', 'msg:"a;b"; content:"x;y"; sid:2;', 'msg:"a\\"b"; content:"x", sid:3', 'msg:"a";\n content:"x";\r\n sid:4;', 'content:"content:"; sid:0;', 'content:"x; sid:5;', 'content : x; sid:6;']
    rules = parse(spark.createDataFrame([(f"alert tcp {a} any -> {a} [80,443] ({b})",) for a in lists for b in bodies], "text string"), counts=True)
    sides = ("src_addr", "src_port", "dst_addr", "dst_port")
    rows = rules.select("text", "ok", "counts", F.size("options").alias("n"), *[F.size(f"{c}.atoms").alias(c) for c in sides]).collect()
    assert all((r.counts.options, *[r.counts[c] for c in sides]) == (r.n, *[r[c] for c in sides]) for r in rows)
    got = {r.text: (r.ok, r.counts.src_addr, r.counts.options) for r in rows}
    of = lambda a, b: got[f"alert tcp {a} any -> {a} [80,443] ({b})"]
    assert [of(a, bodies[0])[:2] for a in lists] == [(True, 1), (True, 2), (True, 2), (True, 0), (True, 2), (True, 2), (True, 3), (False, 1)]
    assert [of("any", b)[::2] for b in bodies] == [(True, 4), (True, 3), (True, 3), (True, 3), (False, 0), (False, 0), (False, 0)]


def test_long_rules_are_counted_without_being_built(spark):
    from sigspark.plans import catalogue

    plan = catalogue.QUERIES["parse_long"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "node_type" not in plan and "IPAddress" not in plan and "modifiers" not in plan
    text = F.expr(
        """concat('alert tcp [', array_join(transform(sequence(1, 300 + id % 7), i -> concat('10.0.', i % 256, '.1')), ','), '] any -> any any (msg:"a', repeat('x', cast(1200 + id % 50 as int)), '"; ',
           array_join(transform(sequence(1, 150 + id % 5), i -> concat('content:"c', i, '";')), ' '), ' sid:', id + 1, ';)')"""
    )
    assert spark.range(-200, 2000).where(text != catalogue.long_text()).count() == 0
