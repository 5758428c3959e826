"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, language_id, line_dedup, mixing, prefix_hash, quality, simhash, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_language_id": language_id.op4_language_id,
    "op5_fingerprints": prefix_hash.op5_fingerprints,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_mix": mixing.op8_mix,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLE_SQL = {
    "op2_url_filter": url_filter.OP2_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op8_mix": mixing.OP8_SQL,
}
