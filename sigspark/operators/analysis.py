"""Corpus statistics, coverage and gaps, the security score, and conflicts between rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import sql_array
from ..functions.cost import option_cost
from ..functions.lineage import cut

#: The classes of message texts in order; the first pattern found in the lower-cased text names the class.
CONTENT_TYPES = (
    ("sql injection", r"(sql|sqli|injection|union\s+select)"),
    ("xss", r"(xss|cross.?site|script.?inject)"),
    ("rce", r"(rce|remote\s+code|command\s+injection|shell)"),
    ("malware", r"(malware|trojan|virus|backdoor|ransomware)"),
    ("exploit", r"(exploit|cve-|vulnerability)"),
    ("phishing", r"(phish|fake\s+login|credential)"),
    ("dos/ddos", r"(dos|ddos|denial|flood|amplification)"),
    ("scan/probe", r"(scan|probe|recon|enumerat)"),
    ("bruteforce", r"(brute.?force|password\s+guess|auth\s+fail)"),
    ("dns", r"(dns|domain|nxdomain)"),
    ("web", r"(http|web|uri|url|request)"),
    ("tls/ssl", r"(tls|ssl|certificate)"),
    ("smtp/email", r"(smtp|email|mail)"),
    ("ftp", r"(ftp|file\s+transfer)"),
    ("ssh", r"(ssh|secure\s+shell)"),
    ("smb", r"(smb|cifs|samba)"),
    ("policy violation", r"(policy|unauthorized|forbidden)"),
)


def distribution(rules: DataFrame, column: str) -> DataFrame:
    """value, cnt and pct (one decimal) of a column, most frequent first by the caller's order."""
    counts = rules.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    total = rules.agg(F.count(F.lit(1)).alias("total"))
    return counts.join(F.broadcast(total)).select(F.lit(column).alias("dimension"), "value", "cnt", F.round(100.0 * F.col("cnt") / F.col("total"), 1).alias("pct"))


def statistics(rules: DataFrame) -> DataFrame:
    """Actions, protocols and directions in one pass over the rules."""
    dims = F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("action", "protocol", "direction")])
    counts = rules.select(F.inline(dims)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("cnt"))
    share = F.sum("cnt").over(Window.partitionBy("dimension"))
    return counts.select("dimension", "value", "cnt", F.round(100.0 * F.col("cnt") / share, 1).alias("pct"))


def aggregate_stats(rules: DataFrame) -> DataFrame:
    """One row: rules, unique sids, rules with errors and with warnings."""
    has = lambda level: F.count_if(F.exists("diagnostics", lambda d: d["level"] == level))
    return rules.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("sid").alias("unique_sids"), has("error").alias("rules_with_errors"), has("warning").alias("rules_with_warnings"))


_SAMPLED = """array_distinct(flatten(transform(filter(concat(src_port.atoms, dst_port.atoms), a -> not a.negated), a -> CASE a.node_type WHEN 'Port' THEN array(a.value)
  WHEN 'PortRange' THEN concat(array(a.start, a.`end`), if(a.`end` - a.start > 10, transform(sequence(1, 4), i -> a.start + i * ((a.`end` - a.start) div 5)), array()))
  ELSE cast(array() as array<int>) END)))"""


def port_coverage(rules: DataFrame) -> DataFrame:
    """port and the number of rules whose source or destination ports cover it; ranges by their ends and, if wide, four samples."""
    return rules.select(F.explode(F.expr(f"cast({_SAMPLED} as array<int>)")).alias("port")).groupBy("port").agg(F.count(F.lit(1)).alias("rules"))


def uncovered_ports(rules: DataFrame) -> DataFrame:
    """Common ports that no rule covers, with their rank in the list."""
    common = rules.sparkSession.createDataFrame([(p, i) for i, p in enumerate(S.COMMON_PORTS)], "port int, rank int")
    return common.join(port_coverage(rules), "port", "left_anti")


def content_type() -> F.Column:
    """The class of the first message: null without one, other if no pattern is found."""
    found = F.lit("other")
    for name, pattern in reversed(CONTENT_TYPES):
        found = F.when(F.lower("msg").rlike(pattern), name).otherwise(found)
    return F.when(F.length("msg") > 0, found)


def content_types(rules: DataFrame, top: int | None = None) -> DataFrame:
    out = rules.select(content_type().alias("content_type")).where("content_type is not null").groupBy("content_type").agg(F.count(F.lit(1)).alias("cnt"))
    return out if top is None else out.orderBy(F.desc("cnt"), "content_type").limit(top)


def gaps(rules: DataFrame) -> DataFrame:
    """gap_type, severity, detail: what the corpus hardly covers."""
    n = F.count(F.lit(1))
    share = lambda c: 100.0 * F.count_if(c) / n
    a = rules.agg(
        n.alias("n"), share(F.col("protocol") == "tcp").alias("tcp"), share(F.col("protocol") == "udp").alias("udp"), share(F.col("protocol") == "icmp").alias("icmp"),
        share(F.col("direction") == "<-").alias("outbound"), share(F.col("action").isin("drop", "reject")).alias("blocking"),
    )
    rows = a.where("n > 0").select(
        F.inline(
            F.expr(
                """filter(array(
          if(tcp > 95, struct('protocol' as gap_type, 'medium' as severity, 'tcp' as detail), null), if(udp < 2 and n >= 100, struct('protocol' as gap_type, 'medium' as severity, 'udp' as detail), null),
          if(icmp < 0.5 and n >= 100, struct('protocol' as gap_type, 'low' as severity, 'icmp' as detail), null), if(outbound < 2 and n >= 100, struct('direction' as gap_type, 'medium' as severity, 'outbound' as detail), null),
          if(blocking < 1 and n >= 100, struct('action' as gap_type, 'low' as severity, 'blocking' as detail), null)), x -> x is not null)"""
            )
        )
    )
    high = F.when(F.col("port").isin(*S.HIGH_PORTS), "high").otherwise("medium")
    some = rules.limit(1).select(F.lit(True).alias("_some"))
    ports = uncovered_ports(rules).join(F.broadcast(some)).select(F.lit("port").alias("gap_type"), high.alias("severity"), F.col("port").cast("string").alias("detail"))
    return ports.unionByName(rows)


def option_usage(rules: DataFrame) -> DataFrame:
    return rules.select(F.explode("options.node_type").alias("node_type")).groupBy("node_type").agg(F.count(F.lit(1)).alias("cnt"))


def cost_breakdown(rules: DataFrame) -> DataFrame:
    """Cost of the options by type, over the corpus."""
    each = rules.select(F.explode(F.expr(f"transform(options, o -> struct(o.node_type as node_type, {option_cost('o')} as cost))")).alias("x"))
    return each.groupBy("x.node_type").agg(F.sum("x.cost").alias("cost"), F.count(F.lit(1)).alias("cnt"))


def security_score(rules: DataFrame) -> DataFrame:
    """score (100 less the weight of each finding, 0 at least), complexity and findings of each rule."""
    count = lambda t: f"size(filter(options, o -> o.node_type = '{t}'))"
    is_any = lambda c: f"({c}.text = 'any')"
    fast = "exists(options, o -> o.node_type = 'FastPatternOption' or exists(coalesce(o.modifiers, array()), m -> m.name = 'fast_pattern'))"
    first_pcre = "get(filter(options, o -> o.node_type = 'PcreOption'), 0).pattern_str"
    findings = {
        "broad_addresses": (f"{is_any('src_addr')} and {is_any('dst_addr')}", 20), "any_ports": (f"{is_any('src_port')} and {is_any('dst_port')}", 10),
        "no_fast_pattern": (f"{count('ContentOption')} >= 2 and not {fast}", 10), "pcre_alone": (f"{count('PcreOption')} > 0 and {count('ContentOption')} = 0", 20),
        "greedy_pcre": (f"coalesce(contains({first_pcre}, '.*') or contains({first_pcre}, '.+'), false)", 10), "no_msg": ("msg is null", 5), "no_sid": ("sid is null", 30),
        "no_classtype": (f"{count('ClasstypeOption')} = 0", 5), "no_reference": (f"{count('ReferenceOption')} = 0", 5),
        "no_threshold": ("exists(dst_port.atoms, a -> a.value in (80, 443, 8080, 8443, 53)) and not exists(options, o -> o.keyword in ('threshold', 'detection_filter'))", 10),
    }
    listed = "filter(array(" + ", ".join(f"if({c}, '{k}', null)" for k, (c, _) in findings.items()) + "), x -> x is not null)"
    lost = " + ".join(f"if({c}, {w}, 0)" for c, w in findings.values())
    tests = "size(filter(options, o -> o.keyword = 'byte_test'))"
    return rules.withColumns(
        {"findings": F.expr(listed), "score": F.expr(f"greatest(0, 100 - ({lost}))"), "complexity": F.expr(f"2 * {count('ContentOption')} + 5 * {count('PcreOption')} + 3 * {tests}")}
    )


def duplicate_sids(rules: DataFrame) -> DataFrame:
    return rules.where("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("rules")).where("rules > 1")


def flowbits_without_setter(rules: DataFrame) -> DataFrame:
    """name and number of checks of flowbits that nothing sets."""
    bits = rules.select(F.explode(F.expr("filter(options, o -> o.node_type = 'FlowbitsOption')")).alias("o")).select("o.action", F.explode(F.split("o.name", "&")).alias("name"))
    checks = bits.where("action in ('isset', 'isnotset')").groupBy("name").agg(F.count(F.lit(1)).alias("checks"))
    return checks.join(bits.where("action in ('set', 'toggle')").select("name").distinct(), "name", "left_anti")


def conflicting_actions(rules: DataFrame) -> DataFrame:
    """signature (hash of header and matching options) with the actions of rules that let pass and rules that block alike."""
    meta = sql_array(S.METADATA_TYPES)
    body = F.expr(f"array_join(array_sort(transform(filter(options, o -> not array_contains({meta}, o.node_type)), o -> o.raw)), ';')")
    sig = F.sha2(F.concat_ws("|", "protocol", "src_addr.text", "src_port.text", "direction", "dst_addr.text", "dst_port.text", body), 256)
    out = rules.groupBy(sig.alias("signature")).agg(F.count(F.lit(1)).alias("rules"), F.max(F.col("action").isin("alert", "log")).alias("_a"), F.max(F.col("action").isin("drop", "reject")).alias("_b"))
    return out.where("_a and _b").select("signature", "rules")


def _port_profiles(rules: DataFrame, id_column: str, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(general, profile), (specific, profile) and, once each, the pairs (g, s) of profiles where a port of s lies in a range of g.

    A profile is all that an id has of one side: its ranges, or its single ports, each with protocol and direction.
    Ids of one profile shadow alike, so only profiles meet, by buckets of ``width`` ports.
    """
    a = rules.select(F.col(id_column).alias("id"), "protocol", "direction", F.explode("dst_port.atoms").alias("a")).where("id is not null and not a.negated and a.node_type in ('Port', 'PortRange')")
    one = "named_struct('protocol', protocol, 'direction', direction, 'lo', coalesce(a.start, a.value), 'hi', coalesce(a.end, a.value))"
    sides = a.groupBy("id", F.expr("a.node_type = 'PortRange'").alias("wide")).agg(F.sort_array(F.collect_set(F.expr(one))).alias("ports"))
    sides = cut(sides.select("id", "wide", "ports", F.sha2(F.to_json("ports"), 256).alias("profile")))
    kinds = cut(sides.groupBy("wide", "profile").agg(F.first("ports").alias("ports"))).select("wide", "profile", F.inline("ports"))
    ranges = kinds.where("wide").select(F.col("profile").alias("g"), "protocol", "direction", "lo", "hi", F.explode(F.expr(f"sequence(lo div {width}, hi div {width})")).alias("bucket"))
    points = kinds.where("not wide").select(F.col("profile").alias("s"), "protocol", "direction", F.col("lo").alias("port"), F.expr(f"lo div {width}").alias("bucket"))
    met = cut(ranges.join(points, ["protocol", "direction", "bucket"]).where("port between lo and hi").select("g", "s").distinct())
    return sides.where("wide").select(F.col("id").alias("general"), "profile"), sides.where("not wide").select(F.col("id").alias("specific"), "profile"), met


def shadowed_ports(rules: DataFrame, id_column: str = "sid", width: int = 64, block: int = 2048) -> DataFrame:
    """(general, specific): rules of one protocol and direction where one's single destination port lies in the other's range.

    Every pair, once. Profiles that meet are joined as blocks of at most some ``block`` ids, and pairs are formed as they
    leave, so that no pair is shuffled or made distinct, and a task holds the pairs of one general id at a time.
    """
    general, specific, met = _port_profiles(rules, id_column, width)

    def blocks(side: DataFrame, c: str, profile: str) -> DataFrame:
        sizes = side.groupBy("profile").agg(F.expr(f"cast(ceil(count(1) / {block}) as int)").alias("blocks"))
        dealt = side.join(sizes, "profile").groupBy("profile", F.expr(f"pmod(xxhash64({c}), blocks)").alias("_block"))
        return dealt.agg(F.collect_list(c).alias(c)).select(F.col("profile").alias(profile), c)

    pairs = met.join(blocks(general, "general", "g"), "g").join(blocks(specific, "specific", "s"), "s").select("general", "specific")
    pairs = pairs.repartition(max(rules.sparkSession.sparkContext.defaultParallelism, int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    # two explodes would be one piece of generated code, which holds all pairs of a block before the first leaves; inline is not generated
    one = pairs.select(F.expr("inline(transform(general, g -> named_struct('general', g)))"), "specific")
    return one.select("general", F.explode("specific").alias("specific")).where("general <> specific")


def shadowed_counts(rules: DataFrame, id_column: str = "sid", width: int = 64) -> DataFrame:
    """(general, rules, first_specific): number and least id of what each rule shadows, as from ``shadowed_ports`` but without its pairs."""
    general, specific, met = _port_profiles(rules, id_column, width)
    least = specific.groupBy("profile").agg(F.count(F.lit(1)).alias("n"), F.min("specific").alias("first"))
    of = met.join(least.withColumnRenamed("profile", "s"), "s").groupBy("g").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    # an id with a port in a range of its own is not its own shadow
    both = general.withColumnRenamed("profile", "g").join(specific.select(F.col("specific").alias("general"), F.col("profile").alias("s")), "general")
    own = cut(both.join(met, ["g", "s"]).select("general", "g", "s"))
    out = general.withColumnRenamed("profile", "g").join(of, "g").join(own.select("general", F.lit(1).alias("self")), "general", "left")
    out = out.select("general", "g", (F.col("n") - F.coalesce("self", F.lit(0))).alias("rules"), "first").where("rules > 0")
    plain = out.where("general <> first").select("general", "rules", F.col("first").alias("first_specific"))
    # where that id is the least itself: the second least of that profile, or the least of another one
    itself = out.where("general = first")
    mine = own.join(itself.select("general", "rules"), "general")
    second = specific.join(least.select("profile", "first"), "profile").where("specific <> first").groupBy("profile").agg(F.min("specific").alias("second"))
    others = met.join(least.select(F.col("profile").alias("x"), "first"), F.col("s") == F.col("x")).select("g", F.col("s").alias("x"), "first")
    next_ = mine.join(others, "g").join(second.withColumnRenamed("profile", "x"), "x", "left").select("general", "rules", F.expr("if(first = general, second, first)").alias("c"))
    return plain.unionByName(next_.groupBy("general", "rules").agg(F.min("c").alias("first_specific")))
