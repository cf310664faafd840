"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from plumbline.llm.anomalies import quality_rules_query
from plumbline.llm.attribution import token_counts_query
from plumbline.llm.byte_bpe import byte_bpe
from plumbline.llm.chat import CHAT_SQL, chat_formatting
from plumbline.llm.circulant import near_duplicates_query
from plumbline.llm.exact import EXACT_SQL, exact_dedup
from plumbline.llm.hostrank import url_filters
from plumbline.llm.middles import FILL_IN_MIDDLE_SQL, fill_in_middle_query
from plumbline.llm.packing import best_fit_packing
from plumbline.llm.quadratic import quality_classifier
from plumbline.llm.resampling import RESAMPLING_SQL, importance_resampling
from plumbline.llm.suffixes import suffix_dedup
from plumbline.llm.topk import TOP_K_SQL, exact_top_k

QUERIES = {
    "op1_chat_formatting": chat_formatting,
    "op2_token_counts": token_counts_query,
    "op3_quality_rules": quality_rules_query,
    "op4_suffix_dedup": suffix_dedup,
    "op5_byte_bpe": byte_bpe,
    "op6_exact_top_k": exact_top_k,
    "op7_near_duplicates": near_duplicates_query,
    "op8_url_filters": url_filters,
    "op9_best_fit_packing": best_fit_packing,
    "op10_quality_classifier": quality_classifier,
    "op11_exact_dedup": exact_dedup,
    "op12_importance_resampling": importance_resampling,
    "op13_fill_in_middle": fill_in_middle_query,
}
ORACLES = {
    "op1_chat_formatting": CHAT_SQL,
    "op6_exact_top_k": TOP_K_SQL,
    "op11_exact_dedup": EXACT_SQL,
    "op12_importance_resampling": RESAMPLING_SQL,
    "op13_fill_in_middle": FILL_IN_MIDDLE_SQL,
}
