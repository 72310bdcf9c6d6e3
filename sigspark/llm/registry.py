"""The registered queries of this subpackage and their SQL."""

from . import decontaminate, html_extract, license_scan, line_dedup, near_dedup, piece_codec, quality_rules, sharding, token_store, url_filter

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_piece_codec": piece_codec.op7_piece_codec,
    "op8_token_store": token_store.op8_token_store,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_near_dedup": near_dedup.ORACLE_SQL,
    "op3_sharding": sharding.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op9_license_scan": license_scan.ORACLE_SQL,
}
