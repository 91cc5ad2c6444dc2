"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from credence.llm import bpe, collocations, exact_dedup, filter_audit, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sharding, simhash_dedup, substring_dedup

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_suffix_dedup": substring_dedup.op5_suffix_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_sharding": sharding.op8_sharding,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_simhash_dedup": simhash_dedup.op11_simhash_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op2_near_dedup": near_dedup.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op5_suffix_dedup": substring_dedup.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
    "op12_collocations": collocations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
