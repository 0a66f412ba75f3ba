"""The training-data queries, and SQL for those that SQL can express."""

from __future__ import annotations

from labelloom.llm import audit, bpe, chat, decontaminate, langid, mixing, quality, scoring, sharding, simhash, substrings, tokens, whitening

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_lm_scoring": scoring.op2_lm_scoring,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_token_output": tokens.op7_token_output,
    "op8_source_mixing": mixing.op8_source_mixing,
    "op9_sharding": sharding.op9_sharding,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_byte_bpe": bpe.op13_byte_bpe,
}

SQL = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op2_lm_scoring": scoring.OP2_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op9_sharding": sharding.OP9_SQL,
    "op11_filter_audit": audit.OP11_SQL,
}
