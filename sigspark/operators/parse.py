"""Rule text to typed columns, in built-in expressions only.

``parse(df, text)`` adds ``action, protocol, src_addr, src_port, direction, dst_addr, dst_port, options, sid,
msg, raw_text, diagnostics, ok``. A text that is no rule becomes an error rule: alert ip any any -> any any
without options, with an ERROR diagnostic (code PARSE_ERROR). Negations, signs and ranges of options are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.columns import let, quoted, sql_array, sql_case

# Every repeated group is possessive: java.util.regex runs those in a loop, others by recursion, which long rules overflow.
_NEST = r"\[(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+\]"
_ATOM = rf"!?+(?:{_NEST}|[^\s\[\]()]++)"
_ELEMENT = rf"[!\s]*+(?:{_NEST}|[^\s\[\],!]++)"
HEADER = (
    r"(?s)^\s*(" + "|".join(S.ACTIONS) + r")\s+([a-z0-9_-]+)(?:\s+(" + _ATOM + r")\s+(" + _ATOM + r")\s+(->|<-|<>)\s+(" + _ATOM + r")\s+(" + _ATOM + r"))?\s*\((.*)\)\s*;?\s*$"
)
_GROUPS, _MARK = 8, "\x01"
_STRING = r'"(?:[^"\\]++|\\.)*+"'
#: Options end at ; and, as in Snort 3, at a comma before a known keyword and its colon.
OPTION = rf'(?s)((?:[^;,"\\]++|{_STRING}|\\.|,(?!\s*+(?:' + "|".join((*S.OPTION_TYPES, *S.GENERIC_KEYWORDS)) + r")\s*+:))++)"
OPTIONS_WHOLE = rf'(?s)^(?:[^;"\\]++|{_STRING}|\\.|;)*+$'
QUOTED = rf"(?s)^!?\s*{_STRING}$"
_ADDRESS = r"^(any|\$\w+|[0-9a-fA-F:.]+(/\d{1,3})?|[0-9a-fA-F:.]+-[0-9a-fA-F:.]+)$"
_PORT = r"^(any|\$\w+|\d{1,6}|\d{1,6}:(\d{1,6})?|:\d{1,6})$"
# What the next two match needs no closer look. Their classes list single characters, as java.util.regex runs those fastest.
#: Options parted by ; alone: no escapes, commas or line ends, and no ; in a string.
_PLAIN_OPTIONS = r'^[^"\\,\n\r]*(?:"[^"\\,;\n\r]*"[^"\\,\n\r]*)*+\z'
#: A flat list of addresses without negations, prefix lengths, ranges, names and white space, all well formed.
_PLAIN_LIST = r"^\[[0123456789abcdefABCDEF:.,]*\]\z"
#: Options that start so have the keyword content and a value that needs no further check.
_PLAIN_CONTENT = 'content:"'

_BODY = rf"(?s)^!?\s*({_STRING}|[|][0-9A-Fa-f\s]*[|])"


def unquote(v: str) -> str:
    """SQL for a string without its quotes and escapes."""
    plain = inner = f"regexp_replace({v}, '(?s)^!?\\\\s*\"(.*)\"$', '$1')"
    for old, new in (("\\\\", "\0"), ('\\"', '"'), ("\\'", "'"), (chr(92) + ";", ";"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\0", "\\")):
        inner = f"replace({inner}, {quoted(old)}, {quoted(new)})"
    return f"if(contains({v}, {quoted(chr(92))}), {inner}, {plain})"


def content_bytes(v: str) -> str:
    """SQL for the bytes of a content: |hex| between literal text; bad hex gives nothing."""
    return (
        f"aggregate(transform(split({v}, '[|]', -1), (x, i) -> if(i % 2 = 0, encode(x, 'utf-8'), coalesce(try_to_binary(regexp_replace(x, '\\\\s', ''), 'hex'), X''))), "
        "X'', (a, b) -> concat(a, b))"
    )


def _pairs(text: str, negated: str, depth: int = 0) -> str:
    """SQL for the leaves (x) of a list with whether an odd number of negations hold them (n), level by level: linear in the text."""
    e, q = f"e{depth}", f"q{depth}"
    odd = f"length(regexp_replace(regexp_extract({e}, '^[!\\\\s]*+', 0), '\\\\s', '')) % 2 = 1"
    bound = f"named_struct('x', regexp_replace({e}, '^[!\\\\s]++', ''), 'n', {negated} <> ({odd}))"
    parts = f"regexp_extract_all({text}, {quoted(_ELEMENT)}, 0)"
    if depth == 4:
        return f"transform({parts}, {e} -> {bound})"
    inner = _pairs(f"substring({q}.x, 2, length({q}.x) - 2)", f"{q}.n", depth + 1)
    return f"flatten(transform(transform({parts}, {e} -> {bound}), {q} -> if({q}.x like '[%', {inner}, array({q}))))"


def _count(text: str, flat: str = "false") -> str:
    """SQL for the number of leaves of an address or port; flat tells that it matches _PLAIN_LIST."""
    gaps = f"contains({text}, ',,') or startswith({text}, '[,') or endswith({text}, ',]') or {text} = '[]'"
    return f"CASE WHEN {flat} and not ({gaps}) THEN size(split({text}, ',')) WHEN not (contains({text}, '[') or contains({text}, '!')) THEN 1 ELSE size({_pairs(text, 'false')}) END"


def _atoms(text: str, port: bool) -> str:
    """SQL for the leaves of an address or port in order, a leaf negated if an odd number of negations hold it."""
    x = "s.x"
    if port:
        kind = f"CASE WHEN {x} = 'any' THEN 'AnyPort' WHEN {x} LIKE '$%' THEN 'PortVariable' WHEN {x} LIKE '%:%' THEN 'PortRange' ELSE 'Port' END"
        leaf = (
            f"named_struct('node_type', {kind}, 'value', try_cast({x} as int), 'start', if({x} LIKE '%:%', coalesce(try_cast(split({x}, ':')[0] as int), 0), null), "
            f"'end', if({x} LIKE '%:%', coalesce(try_cast(get(split({x}, ':', -1), 1) as int), 65535), null), 'name', if({x} LIKE '$%', substring({x}, 2), null), 'negated', s.n)"
        )
    else:
        kind = f"CASE WHEN {x} = 'any' THEN 'AnyAddress' WHEN {x} LIKE '$%' THEN 'AddressVariable' WHEN {x} LIKE '%/%' THEN 'IPCIDRRange' WHEN {x} LIKE '%-%' THEN 'IPRange' ELSE 'IPAddress' END"
        leaf = (
            f"named_struct('node_type', {kind}, 'value', if({kind} = 'IPAddress', {x}, null), 'version', if({x} = 'any' or {x} LIKE '$%', null, if({x} LIKE '%:%', 6, 4)), "
            f"'network', if({x} LIKE '%/%', split({x}, '/')[0], null), 'prefix_len', if({x} LIKE '%/%', try_cast(get(split({x}, '/'), 1) as int), null), "
            f"'start', if({x} LIKE '%-%', split({x}, '-')[0], null), 'end', if({x} LIKE '%-%', get(split({x}, '-'), 1), null), 'name', if({x} LIKE '$%', substring({x}, 2), null), 'negated', s.n)"
        )
    plain = f"not (contains({text}, '[') or contains({text}, '!'))"
    return f"transform(if({plain}, array(named_struct('x', {text}, 'n', false)), {_pairs(text, 'false')}), s -> {leaf})"


def _side(text: str, port: bool) -> Column:
    kind = f"CASE WHEN {text} LIKE '!%' THEN 'negation' WHEN {text} LIKE '[%' THEN 'list' ELSE 'single' END"
    canon = f"regexp_replace({text}, '\\\\s*,\\\\s*', ', ')"
    if port:
        canon = f"regexp_replace({canon}, '(\\\\d+):(?=$|[,\\\\]])', '$1:65535')"
    return F.expr(f"named_struct('kind', {kind}, 'text', {canon}, 'atoms', {_atoms(text, port)})")


def _option_type(k: str) -> str:
    table = dict(S.OPTION_TYPES) | {b: "BufferSelectOption" for b in S.BUFFERS} | {b.replace("_", ".", 1): "BufferSelectOption" for b in S.BUFFERS}
    types = sql_array(["GenericOption", *table.values()])
    return f"{types}[array_position({sql_array(table)}, {k})]"


def _option_struct() -> str:
    """SQL: the typed option of x, (k, v, t), at place i."""
    x, v = "x", "x.v"
    is_content = "x.k IN ('content', 'uricontent')"
    body = f"regexp_extract({v}, '(?s)^!?\\\\s*(\"(?:[^\"\\\\\\\\]|\\\\\\\\.)*\"|[|][0-9A-Fa-f\\\\s]*[|])', 1)"
    inner = f"regexp_replace({body}, '(?s)^\"(.*)\"$', '$1')"
    unescaped = f"replace(replace(replace({inner}, {quoted(chr(92) + chr(34))}, '\"'), {quoted(chr(92) + ';')}, ';'), {quoted(chr(92) * 2)}, {quoted(chr(92))})"
    rest = f"regexp_replace(substring({v}, locate({body}, {v}) + length({body})), '^\\\\s*,', '')"
    parts = f"filter(transform(split({rest}, ','), m -> trim(m)), m -> m <> '')"
    modifier = (
        f"transform({parts}, m -> named_struct('name', if(array_contains({sql_array(S.MODIFIERS)}, regexp_extract(m, '^(\\\\w+)', 1)), regexp_extract(m, '^(\\\\w+)', 1), 'nocase'), "
        "'int_value', try_cast(regexp_extract(m, '^\\\\w+[ :]+(-?\\\\d+)$', 1) as int), 'str_value', nullif(regexp_extract(m, '^\\\\w+[ :]+([^\\\\d-].*)$', 1), '')))"
    )
    pcre = f"{unquote_plain(v)}"
    entries = f"transform(split({v}, ','), e -> named_struct('key', regexp_extract(trim(e), '^(\\\\S+)', 1), 'value', trim(regexp_extract(trim(e), '(?s)^\\\\S+\\\\s*(.*)$', 1))))"
    words = f"transform(split({v}, ','), e -> trim(e))"
    on = lambda keys, e: f"if(x.k IN ({', '.join(quoted(k) for k in keys)}), {e}, null)"
    numbers = ("sid", "rev", "gid", "priority", "depth", "offset", "distance", "within")
    fields = {
        "ordinal": "cast(i as int)",
        "node_type": "x.t",
        "keyword": "x.k",
        "text": on(("msg",), unquote(v)),
        "value_int": on(numbers, f"try_cast(trim({v}) as bigint)"),
        "value_str": f"CASE WHEN x.k IN {('classtype', *numbers[4:])} THEN trim({v}) WHEN x.t = 'GenericOption' THEN {unquote_plain(v)} END",
        "ref_type": on(("reference",), f"trim(split({v}, ',', 2)[0])"),
        "ref_id": on(("reference",), f"trim(get(split({v}, ',', 2), 1))"),
        "entries": on(("metadata",), entries),
        "pattern": f"if({is_content}, {content_bytes(unescaped)}, null)",
        "modifiers": f"if({is_content}, {modifier}, null)",
        "pattern_str": on(("pcre",), f"if({pcre} rlike '(?s)^/(.*)/(\\\\w*)$', regexp_extract({pcre}, '(?s)^/(.*)/(\\\\w*)$', 1), {pcre})"),
        "flags": on(("pcre",), f"regexp_extract({pcre}, '(?s)^/(.*)/(\\\\w*)$', 2)"),
        "directions": on(("flow",), f"filter({words}, e -> array_contains({sql_array(S.FLOW_DIRECTIONS)}, e))"),
        "states": on(("flow",), f"filter({words}, e -> array_contains({sql_array(S.FLOW_STATES)}, e))"),
        "action": on(("flowbits",), f"{words}[0]"),
        "name": on(("flowbits",), f"replace(get({words}, 1), '|', '&')"),
        "buffer_name": "if(x.t = 'BufferSelectOption', x.k, null)",
        "offset": on(("fast_pattern",), f"try_cast(get({words}, 0) as int)"),
        "length": on(("fast_pattern",), f"try_cast(get({words}, 1) as int)"),
        "direction": on(("filestore",), f"nullif(get({words}, 0), '')"),
        "scope": on(("filestore",), f"get({words}, 1)"),
        "script_name": on(("lua", "luajit"), f"regexp_replace(trim({v}), '^!', '')"),
        "negated": f"coalesce({v} like '!%' and x.k in ('content', 'uricontent', 'pcre', 'lua', 'luajit'), false)",
        "raw": "if(x.v is null, x.k, concat(x.k, ':', x.v))",
    }
    return "named_struct(" + ", ".join(f"{quoted(k)}, {e}" for k, e in fields.items()) + ")"


def _given(side: str) -> str:
    """SQL for a side of a rule, any of an error rule."""
    return f"if(_error is null, {side}, 'any')"


def unquote_plain(v: str) -> str:
    """SQL for a string without its outer quotes; escapes stay, as patterns need them."""
    return f"regexp_replace(trim({v}), '(?s)^!?\\\\s*\"(.*)\"$', '$1')"


def parse(df: DataFrame, text: str = "text", dialect: str = "suricata", max_length: int = 100_000, max_options: int = 1000, counts: bool = False) -> DataFrame:
    """Adds the columns of a rule to df.

    Guards come first: a text over max_length is never looked at. Validity depends on the header and the split
    options alone, so a query that reads neither typed options nor address leaves does not compute them. With counts,
    a struct counts has the sizes of options and of the leaves of src_addr, src_port, dst_addr and dst_port, which are not built for it.
    """
    rows = df.withColumn("raw_text", F.trim(F.col(text)))
    rows = rows.withColumn("_long", F.expr(f"if(octet_length(raw_text) <= {max_length}, false, length(raw_text) > {max_length})"))
    marked = F.regexp_replace(F.expr(f"if(not _long and not startswith(raw_text, '{_MARK}'), raw_text, '')"), HEADER, _MARK + _MARK.join(f"${i}" for i in range(1, _GROUPS + 1)))
    rows = rows.withColumn("_m", marked)  # one match for all groups
    nothing = F.array(*[F.lit("")] * _GROUPS)
    rows = let(rows, _h=F.when(F.expr(f"startswith(_m, '{_MARK}')"), F.slice(F.split("_m", _MARK, _GROUPS + 1), 2, _GROUPS)).otherwise(nothing)).drop("_m")
    side = lambda i: F.when(F.col("_h")[i] == "", "any").otherwise(F.col("_h")[i])
    protocol = F.expr(f"CASE WHEN _h[1] = 'ssl' THEN 'tls' WHEN _h[1] = 'ftp_data' THEN 'ftp-data' WHEN _h[1] IN ({', '.join(quoted(p) for p in S.PROTOCOLS)}) THEN _h[1] END")
    plain = {n: F.expr(f"_h[{i}] rlike {quoted(r)}") for n, i, r in (("_p", 7, _PLAIN_OPTIONS), ("_sap", 2, _PLAIN_LIST), ("_dap", 5, _PLAIN_LIST))}
    rows = rows.withColumns({**plain, "_sa": side(2), "_sp": side(3), "_da": side(5), "_dp": side(6), "_protocol": protocol, "_action": F.col("_h")[0], "_way": F.col("_h")[4], "_body": F.col("_h")[7]}).drop("_h")
    parts = f"if(_p, split(_body, ';'), regexp_extract_all(replace(replace(_body, '\\n', ' '), '\\r', ' '), {quoted(OPTION)}, 1))"
    rows = rows.withColumns({"_o": F.expr(f"filter(transform({parts}, o -> trim(o)), o -> o <> '')"), "_whole": F.expr(f"_p or _body rlike {quoted(OPTIONS_WHOLE)}")})
    whole = r"trim(regexp_extract(o, '(?s)^[A-Za-z0-9_.-]+\\s*[: ]?\\s*(.*)$', 1))"
    keyed = lambda a: f"transform({a}, o -> named_struct('k', regexp_extract(o, '^([A-Za-z0-9_.-]+)', 1), 'v', {whole}))"
    value = r"nullif(x.v, '')"
    checked = F.expr(f"transform({keyed(f'filter(_o, o -> not startswith(o, {quoted(_PLAIN_CONTENT)}))')}, x -> named_struct('k', x.k, 'v', {value}))")
    rows = rows.withColumn("_c", checked)
    leaves = lambda c: f"regexp_extract_all({c}, '([^!\\\\[\\\\],\\\\s]+)', 1)"
    number = "coalesce(try_cast({} as int), 0)"
    bad_address = lambda c: f"({c} <> 'any' and not {c}p and exists({leaves(c)}, t -> not t rlike {quoted(_ADDRESS)} or try_cast(get(split(t, '/'), 1) as int) > 128))"
    low, high = number.format("split(t, ':')[0]"), "coalesce(try_cast(get(split(t, ':', -1), 1) as int), if(t LIKE '%:%', 65535, 0))"
    bad_port = lambda c: f"({c} <> 'any' and exists({leaves(c)}, t -> not t rlike {quoted(_PORT)} or {low} > 65535 or {high} > 65535 or (t LIKE '%:%' and {low} > {high})))"
    value_of = "coalesce(try_cast(trim(x.v) as bigint), 0)"
    problems = {
        "rule is longer than the limit": "_long",
        "header is malformed": "_action = ''",
        "unknown protocol": "_protocol is null",
        "too many options": f"size(_o) > {max_options}",
        "options are malformed": "not _whole or exists(_c, x -> x.k = '')",
        "address is malformed": f"{bad_address('_sa')} or {bad_address('_da')}",
        "port is malformed": f"{bad_port('_sp')} or {bad_port('_dp')}",
        "quoted value is malformed": f"exists(_c, x -> x.k in ('msg', 'pcre') and not coalesce(x.v rlike {quoted(QUOTED)}, false))",
        "content is malformed": "exists(_c, x -> x.k in ('content', 'uricontent') and not coalesce(x.v rlike '(?s)^!?\\\\s*(\"|[|][0-9A-Fa-f\\\\s]*[|])', false))",
        "number is out of range": f"exists(_c, x -> (x.k in ('sid', 'rev', 'gid') and {value_of} < 1) or (x.k = 'priority' and not {value_of} between 1 and 4))",
    }
    error = F.expr("CASE WHEN raw_text is null THEN 'no text' " + " ".join(f"WHEN {e} THEN {quoted(m)}" for m, e in problems.items()) + " END")
    rows = let(rows, _error=error)  # a filter on ok stops here
    ok = F.col("_error").isNull()
    rows = rows.withColumns(
        {
            "ok": ok,
            "dialect": F.lit(dialect),
            "action": F.when(ok, F.col("_action")).otherwise("alert"),
            "protocol": F.when(ok, F.col("_protocol")).otherwise("ip"),
            "direction": F.when(ok & (F.col("_way") != ""), F.col("_way")).otherwise("->"),
            **{n: _side(c, n.endswith("port")) for n, c in (("src_addr", _given("_sa")), ("src_port", _given("_sp")), ("dst_addr", _given("_da")), ("dst_port", _given("_dp")))},
            "options": F.expr(f"transform(transform({keyed('if(_error is null, _o, slice(_o, 1, 0))')}, x -> named_struct('k', x.k, 'v', {value}, 't', {_option_type('x.k')})), (x, i) -> {_option_struct()})"),
            "sid": F.when(ok, F.expr("try_cast(trim(get(filter(_c, x -> x.k = 'sid'), 0).v) as bigint)")),
            "msg": F.when(ok, F.expr(unquote("get(filter(_c, x -> x.k = 'msg'), 0).v"))),
        }
    )
    warn = F.expr(
        """concat(if(exists(concat(src_addr.atoms, dst_addr.atoms), a -> a.version = 4 and a.prefix_len > 32),
              array(named_struct('level', 'warning', 'code', 'CIDR_PREFIX', 'message', 'IPv4 prefix is over 32')), array()),
            if(exists(_c, x -> x.k = 'uricontent'), array(named_struct('level', 'warning', 'code', 'DEPRECATED', 'message', 'uricontent is deprecated')), array()))"""
    )
    failed = F.array(F.struct(F.lit("error").alias("level"), F.lit("PARSE_ERROR").alias("code"), F.col("_error").alias("message")))
    rows = rows.withColumn("diagnostics", F.when(F.col("ok"), warn).otherwise(failed))
    if counts:
        sides = (("src_addr", "_sa", "_sap"), ("src_port", "_sp", "false"), ("dst_addr", "_da", "_dap"), ("dst_port", "_dp", "false"))
        sizes = ", ".join(f"'{n}', if(_error is null, {_count(c, flat)}, 1)" for n, c, flat in sides)
        rows = rows.withColumn("counts", F.expr(f"named_struct('options', if(_error is null, size(_o), 0), {sizes})"))
    return rows.drop("_long", "_p", "_action", "_way", "_body", "_whole", "_o", "_c", "_sa", "_sp", "_da", "_dp", "_sap", "_dap", "_protocol", "_error")


def locations(rules: DataFrame) -> DataFrame:
    """Adds locations: for each option (ordinal, offset from 0 in raw_text, line and column from 1) of its keyword; none for error rules."""
    body = "if(ok, regexp_extract(raw_text, '(?s)^[^(]*[(](.*)[)]\\\\s*;?\\\\s*$', 1), '')"
    rows = let(rules, _start=F.expr("length(regexp_extract(raw_text, '(?s)^([^(]*[(])', 1))"), _marked=F.split(F.regexp_replace(F.expr(body), OPTION, f"{_MARK}$1"), _MARK, -1))
    rows = let(rows, _sizes=F.transform("_marked", F.length))
    first = "_start + aggregate(slice(_sizes, 1, i), 0, (a, n) -> a + n)"
    lead = "length(regexp_extract(p, '^(\\\\s*+)', 1))"
    found = F.expr(f"filter(transform(_marked, (p, i) -> if(i > 0 and trim(translate(p, ';,', '  ')) <> '', {first} + {lead}, null)), o -> o is not null)")
    rows = let(rows, _at=found)
    place = "named_struct('ordinal', i, 'offset', o, 'line', 1 + length(left(raw_text, o)) - length(replace(left(raw_text, o), '\n', '')), 'column', length(substring_index(left(raw_text, o), '\n', -1)) + 1)"
    return let(rows, locations=F.expr(f"transform(_at, (o, i) -> {place})")).drop("_start", "_marked", "_sizes", "_at")


def parse_strict(df: DataFrame, text: str = "text", **options) -> DataFrame:
    """parse, but a text that is no rule fails the query."""
    rows = parse(df, text, **options)
    return rows.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), F.col("diagnostics")[0]["message"]))))
