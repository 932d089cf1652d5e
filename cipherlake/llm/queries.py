"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import base, byte_bpe, context_mixing, decontaminate, html_extract, near_dup, pii, quality, secret_scan, token_counts, toxicity

QUERIES = {
    "op1_context_mixing": context_mixing.query,
    "op2_quality_rules": quality.query,
    "op3_token_counts": token_counts.query,
    "op4_toxicity": toxicity.query,
    "op5_pii": pii.query,
    "op6_benchmark_decontamination": decontaminate.query,
    "op7_html_extraction": html_extract.query,
    "op8_byte_bpe": byte_bpe.query,
    "op9_minhash_near_dedup": near_dup.query,
    "op10_secret_scans": secret_scan.query,
    **base.QUERIES,
}
ORACLE_SQL = {"op6_benchmark_decontamination": decontaminate.ORACLE, "op9_minhash_near_dedup": near_dup.ORACLE, **base.ORACLE_SQL}
