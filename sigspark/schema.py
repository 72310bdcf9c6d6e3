"""Vocabularies of the rule language and the value tables of its analyses.

Fixed values: these lists state the language itself, or numbers that results must agree on.
"""

ACTIONS = ("alert", "log", "pass", "drop", "reject", "sdrop")
PROTOCOLS = (
    "tcp", "udp", "icmp", "ip", "http", "http2", "dns", "tls", "ssh", "ftp", "ftp-data", "smb", "smtp", "imap", "dcerpc", "dhcp", "nfs", "sip", "rdp", "mqtt",
    "modbus", "dnp3", "enip", "ike", "krb5", "ntp", "snmp", "tftp",
)
PROTOCOL_ALIASES = {"ssl": "tls", "ftp_data": "ftp-data"}
DIRECTIONS = ("->", "<-", "<>")
DIALECTS = ("suricata", "snort2", "snort3")
FLOW_DIRECTIONS = ("to_client", "to_server", "from_client", "from_server")
FLOW_STATES = ("established", "not_established", "stateless", "only_stream", "no_stream")
MODIFIERS = ("nocase", "offset", "depth", "distance", "within", "rawbytes", "fast_pattern", "startswith", "endswith", "bsize")
BUFFERS = (
    "http_uri", "http_raw_uri", "http_method", "http_header", "http_raw_header", "http_cookie", "http_user_agent", "http_host", "http_stat_code", "http_stat_msg",
    "http_client_body", "http_server_body", "file_data", "pkt_data", "dns_query", "tls_sni", "tls_cert_subject", "tls_cert_issuer", "ssh_proto", "ssh_software",
)
#: keyword -> node type
OPTION_TYPES = {
    "msg": "MsgOption", "sid": "SidOption", "rev": "RevOption", "gid": "GidOption", "classtype": "ClasstypeOption", "priority": "PriorityOption",
    "reference": "ReferenceOption", "metadata": "MetadataOption", "content": "ContentOption", "uricontent": "ContentOption", "pcre": "PcreOption",
    "flow": "FlowOption", "flowbits": "FlowbitsOption", "fast_pattern": "FastPatternOption", "filestore": "FilestoreOption", "lua": "LuaOption",
    "luajit": "LuajitOption", "depth": "DepthOption", "offset": "OffsetOption", "distance": "DistanceOption", "within": "WithinOption",
    "nocase": "NocaseOption", "rawbytes": "RawbytesOption", "startswith": "StartswithOption", "endswith": "EndswithOption",
}
#: Keywords kept as generic options; like those of OPTION_TYPES, they end the option before a comma.
GENERIC_KEYWORDS = (
    "flowint", "threshold", "detection_filter", "byte_test", "byte_jump", "byte_extract", "byte_math", "isdataat", "urilen", "tag", "flags", "dsize", "itype", "icode",
    "ttl", "window", "ipopts", "fragbits", "target",
)
METADATA_TYPES = ("GidOption", "SidOption", "RevOption", "MsgOption", "ClasstypeOption", "PriorityOption", "ReferenceOption", "MetadataOption")
#: Cost of an option by node type; types not listed cost DEFAULT_COST.
BASE_COSTS = {
    "FlowOption": 1.0, "FlowbitsOption": 1.5, **dict.fromkeys(METADATA_TYPES, 0.1), "ContentOption": 10.0, "FastPatternOption": 0.5, "ByteTestOption": 20.0,
    "ByteJumpOption": 15.0, "ByteExtractOption": 18.0, "BufferSelectOption": 5.0, "PcreOption": 100.0, "ThresholdOption": 2.0, "DetectionFilterOption": 2.0,
    "TagOption": 3.0, "FilestoreOption": 5.0, "DepthOption": 0.5, "OffsetOption": 0.5, "DistanceOption": 0.5, "WithinOption": 0.5, "NocaseOption": 0.2,
    "RawbytesOption": 0.3, "StartswithOption": 0.3, "EndswithOption": 0.3, "GenericOption": 5.0,
}
DEFAULT_COST = 5.0
MODIFIER_FACTORS = {"nocase": 1.5, "depth": 0.9, "offset": 0.9, "distance": 0.95, "within": 0.95, "fast_pattern": 0.7, "rawbytes": 1.1, "startswith": 0.8, "endswith": 0.8}
PCRE_FLAG_FACTORS = {"i": 1.3, "s": 1.1, "m": 1.1, "x": 1.0, "U": 1.2, "R": 1.4, "B": 1.3}
#: Place of an option type in an optimised rule; types not listed take 50.
REORDER = {
    "FlowOption": 1, "FlowbitsOption": 2, "ContentOption": 3, "FastPatternOption": 3, "BufferSelectOption": 4, "ByteTestOption": 5, "ByteJumpOption": 5,
    "ByteExtractOption": 5, "DepthOption": 6, "OffsetOption": 6, "DistanceOption": 6, "WithinOption": 6, "NocaseOption": 6, "RawbytesOption": 6,
    "StartswithOption": 6, "EndswithOption": 6, "PcreOption": 10, "ThresholdOption": 15, "DetectionFilterOption": 15, "TagOption": 15, "FilestoreOption": 15,
    "GenericOption": 50, **dict.fromkeys(METADATA_TYPES, 100),
}
NEVER_REDUNDANT = ("MsgOption", "SidOption", "RevOption", "GidOption", "ReferenceOption", "MetadataOption")
COMMON_PORTS = (20, 21, 22, 23, 25, 53, 80, 110, 143, 443, 445, 993, 995, 1433, 3306, 3389, 5432, 5900, 8080, 8443)
HIGH_PORTS = (80, 443, 22, 445)
PORT_NAMES = {
    20: "FTP Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 80: "HTTP", 110: "POP3", 143: "IMAP", 443: "HTTPS", 445: "SMB", 993: "IMAPS", 995: "POP3S",
    1433: "MS SQL", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 8080: "HTTP-Alt", 8443: "HTTPS-Alt",
}


class RuleError(Exception):
    """Base of the engine's errors."""


class ParseError(RuleError):
    """A rule text does not follow the language."""


class QueryError(RuleError):
    """Base of selector errors."""


class QuerySyntaxError(QueryError):
    """A selector does not follow its grammar."""


class InvalidSelectorError(QueryError):
    """A selector is well formed but means nothing."""


class QueryExecutionError(QueryError):
    """A query failed while it ran."""


class BuilderError(RuleError):
    """A builder lacks a required part."""
