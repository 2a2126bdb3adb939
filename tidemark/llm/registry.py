"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontam, html_text, langid, maxscore, mixing, neardup, pii, quality, sharding, stream_dedup, toxicity, va_file

QUERIES = {
    "op1_risk_controlled_quality": quality.op1_risk_controlled_quality,
    "op2_sainte_lague_mix": mixing.op2_sainte_lague_mix,
    "op3_subword_toxicity": toxicity.op3_subword_toxicity,
    "op4_hash_tree_shards": sharding.op4_hash_tree_shards,
    "op5_lsh_forest_near_duplicates": neardup.op5_lsh_forest_near_duplicates,
    "op6_block_tree_extraction": html_text.op6_block_tree_extraction,
    "op7_output_code_language": langid.op7_output_code_language,
    "op8_budgeted_windows": chat.op8_budgeted_windows,
    "op9_bootstrapped_pii": pii.op9_bootstrapped_pii,
    "op10_winnowing_decontamination": decontam.op10_winnowing_decontamination,
    "op11_va_file_hard_negatives": va_file.op11_va_file_hard_negatives,
    "op12_streaming_exact_dedup": stream_dedup.op12_streaming_exact_dedup,
    "op13_maxscore_search": maxscore.op13_maxscore_search,
}

ORACLES = {
    "op1_risk_controlled_quality": quality.ORACLE,
    "op2_sainte_lague_mix": mixing.ORACLE,
    "op4_hash_tree_shards": sharding.ORACLE,
    "op8_budgeted_windows": chat.ORACLE,
    "op10_winnowing_decontamination": decontam.ORACLE,
    "op11_va_file_hard_negatives": va_file.ORACLE,
    "op12_streaming_exact_dedup": stream_dedup.ORACLE,
    "op13_maxscore_search": maxscore.ORACLE,
}
