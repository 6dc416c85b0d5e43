"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontaminate, exact_dedup, language_id, line_dedup, near_dedup, secrets, suffix_dedup, token_files, url_filter

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_language_id": language_id.op4_language_id,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
}
