"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, lm_score, near_dedup, packing, quality_gam, quality_rules, secret_scan, token_counts, toxicity

QUERIES = {
    "op1_lm_score": lm_score.query,
    "op2_quality_rules": quality_rules.query,
    "op4_token_counts": token_counts.query,
    "op3_near_dedup": near_dedup.query,
    "op5_decontamination": decontaminate.query,
    "op6_chat_format": chat_format.query,
    "op7_secret_scan": secret_scan.query,
    "op8_quality_gam": quality_gam.query,
    "op9_toxicity": toxicity.query,
    "op10_best_fit_packing": packing.query,
}

ORACLES: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE,
}
