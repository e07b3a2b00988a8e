"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from . import conversation_trie, decontaminate, jaccard, lexical, license_scan, lm_score, mixing, nearest, quality, secret_scan, substring_dedup, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_nearest": nearest.op2_nearest,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_quality": quality.op7_quality,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_lm_score": lm_score.op9_lm_score,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_secret_scan": secret_scan.op11_secret_scan,
    "op12_ranked_search": lexical.op12_ranked_search,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLES = {"op1_url_filter": url_filter.ORACLE, "op3_mix_sources": mixing.ORACLE, "op4_jaccard": jaccard.ORACLE, "op12_ranked_search": lexical.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
