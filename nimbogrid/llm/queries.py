"""The queries of the dealt operators, and SQL for those that SQL can express."""

from . import collocations, decontamination, exact_dedup, filter_audit, html_extraction, language_id, packing, quality, quality_rules, sharding, simhash_dedup, substring_dedup, suffix_dedup

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_simhash_dedup": simhash_dedup.op2,
    "op3_suffix_dedup": suffix_dedup.op3,
    "op4_sharding": sharding.op4,
    "op5_quality": quality.op5,
    "op6_decontamination": decontamination.op6,
    "op7_html_extraction": html_extraction.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_substring_dedup": substring_dedup.op9,
    "op10_packing": packing.op10,
    "op11_quality_rules": quality_rules.op11,
    "op12_collocations": collocations.op12,
    "op13_filter_audit": filter_audit.op13,
}

ORACLES = {
    "op6_decontamination": decontamination.OP6_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_quality_rules": quality_rules.OP11_SQL,
    "op12_collocations": collocations.OP12_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
