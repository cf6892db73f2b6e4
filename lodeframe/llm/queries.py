"""The registered queries of this subpackage, and DuckDB SQL for those it can express."""

from __future__ import annotations

from lodeframe.llm import op1_toxicity, op2_packing, op3_pii, op4_substring, op5_simhash, op6_suffix, op7_chat, op8_decontam, op9_topk, op10_katz, op11_parity_join, op12_prefix_trie, op13_spelling

QUERIES = {
    "op1_toxicity": op1_toxicity.query,
    "op2_packing": op2_packing.query,
    "op3_pii": op3_pii.query,
    "op4_substring_dedup": op4_substring.query,
    "op5_simhash_dedup": op5_simhash.query,
    "op6_suffix_dedup": op6_suffix.query,
    "op7_chat_format": op7_chat.query,
    "op8_decontaminate": op8_decontam.query,
    "op9_top_k": op9_topk.query,
    "op10_katz_scores": op10_katz.query,
    "op11_parity_join": op11_parity_join.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_spelling_forms": op13_spelling.query,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": op4_substring.ORACLE,
    "op6_suffix_dedup": op6_suffix.ORACLE,
    "op7_chat_format": op7_chat.ORACLE,
    "op8_decontaminate": op8_decontam.ORACLE,
    "op9_top_k": op9_topk.ORACLE,
    "op11_parity_join": op11_parity_join.ORACLE,
    "op12_prefix_trie": op12_prefix_trie.ORACLE,
    "op13_spelling_forms": op13_spelling.ORACLE,
}
