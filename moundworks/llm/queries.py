"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from moundworks.llm import clustering, decontamination, language_id, line_dedup, lm_scoring, mixing, near_dup, pii, quality_rules, source_audit, suffix_dedup, token_counts, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_pii": pii.op6_pii,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_jaccard_join": near_dup.op9_jaccard_join,
    "op10_language_id": language_id.op10_language_id,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_centroid_clustering": clustering.op13_centroid_clustering,
}
QUERIES["quality_ablations"] = quality_rules.quality_ablations
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_url_filter": url_filter.OP2_SQL,
    "op4_suffix_dedup": suffix_dedup.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op7_decontamination": decontamination.OP7_SQL,
    "op8_quality_rules": quality_rules.OP8_SQL,
    "op9_jaccard_join": near_dup.OP9_SQL,
    "op12_source_audit": source_audit.OP12_SQL,
    "op13_centroid_clustering": clustering.OP13_SQL,
    "quality_ablations": quality_rules.ABLATIONS_SQL,
}
