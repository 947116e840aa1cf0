"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, chat, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, topk, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_packing": packing.query,
    "op3_quality_classifier": quality.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_mixing": mixing.query,
    "op6_chat_formatting": chat.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_exact_top_k": topk.query,
    "op9_approximate_nearest_neighbours": ann.query,
    "op10_warc": warc.query,
}

ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op4_suffix_array_dedup": suffix_dedup.ORACLE_SQL,
    "op6_chat_formatting": chat.ORACLE_SQL,
    "op8_exact_top_k": topk.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
}
