"""The registered queries of the text operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from chronoloom.llm import byte_bpe, decontaminate, host_rules, line_dedup, near_dedup, pseudonyms, quotes, rule_ensemble, token_files, toxicity

QUERIES = {
    "op1_rule_ensemble": rule_ensemble.op1_rule_ensemble,
    "op2_pseudonyms": pseudonyms.op2_pseudonyms,
    "op3_token_files": token_files.op3_token_files,
    "op4_host_rules": host_rules.op4_host_rules,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quote_linking": quotes.op6_quote_linking,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLE_SQL = {
    "op4_host_rules": host_rules.ORACLE_SQL,
    "op5_line_dedup": line_dedup.ORACLE_SQL,
    "op10_near_dedup": near_dedup.ORACLE_SQL,
}
