"""The opN_ queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from wayfold.llm import decontamination, filter_audit, html_extraction, lm_scoring, mixing, ngram_join, quality_classifier, quality_rules, ranked_search, sharding, suffix_dedup, token_counts, url_filters

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_sharding": sharding.op7_sharding,
    "op8_lm_scoring": lm_scoring.op8_lm_scoring,
    "op9_mixing": mixing.op9_mixing,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_url_filters": url_filters.op12_url_filters,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

SQL = {**suffix_dedup.SQL, **ngram_join.SQL, **lm_scoring.SQL, **quality_rules.SQL, **sharding.SQL, **mixing.SQL, **filter_audit.SQL, **url_filters.SQL, **ranked_search.SQL}
