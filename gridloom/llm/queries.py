"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from gridloom.llm import ann, decontam, langid, license_scan, packing, quality, simhash, sstable, substring, toxicity

QUERIES = {
    "op1_simhash_near_dedup": simhash.query,
    "op2_decontaminate": decontam.query,
    "op3_substring_dedup": substring.query,
    "op4_kmeans_tree_ann": ann.query,
    "op5_toxicity": toxicity.query,
    "op6_best_fit_packing": packing.query,
    "op7_license_scan": license_scan.query,
    "op8_sstable_tokens": sstable.query,
    "op9_language_id": langid.query,
    "op10_quality_pu": quality.query,
}

ORACLE: dict[str, str] = {
    "op2_decontaminate": decontam.oracle_sql(),
    "op3_substring_dedup": substring.oracle_sql(),
    "op7_license_scan": license_scan.oracle_sql(),
}
