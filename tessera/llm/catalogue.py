"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import html_text, licences, lm, mixing, near_dup, packing, private, quality, toxic, vector_dup


def queries() -> dict:
    return {
        "op1_lm_scoring": lm.query,
        "op2_best_fit_packing": packing.query,
        "op3_source_mixing": mixing.query,
        "op4_toxicity": toxic.query,
        "op5_html_extraction": html_text.query,
        "op6_license_scan": licences.query,
        "op7_minhash_near_dedup": near_dup.query,
        "op8_quality_rules": quality.query,
        "op9_pii": private.query,
        "op10_embedding_near_dedup": vector_dup.query,
        "quality_ablations": quality.ablation_query,
    }


def oracle_sql() -> dict:
    return {
        "op3_source_mixing": mixing.SQL,
        "op6_license_scan": licences.SQL,
        "op8_quality_rules": quality.SQL,
        "op10_embedding_near_dedup": vector_dup.SQL,
        "quality_ablations": quality.ABLATION_SQL,
    }
