"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, fim, kmtree, lexical, licences, mixing, neardup, packing, paragraphs, pivots, tokenfiles, toxicity, urls

QUERIES = {
    "op1_pivot_permutation": pivots.op1_pivot_permutation,
    "op2_genetic_packing": packing.op2_genetic_packing,
    "op3_perfect_hash_ids": tokenfiles.op3_perfect_hash_ids,
    "op4_link_graph_urls": urls.op4_link_graph_urls,
    "op5_nbsvm_toxicity": toxicity.op5_nbsvm_toxicity,
    "op6_kmeans_tree_search": kmtree.op6_kmeans_tree_search,
    "op7_paragraph_minhash": paragraphs.op7_paragraph_minhash,
    "op8_pareto_mixing": mixing.op8_pareto_mixing,
    "op10_prefix_target_chat": chat.op10_prefix_target_chat,
    "op9_dart_minhash": neardup.op9_dart_minhash,
    "op11_marker_injection_fim": fim.op11_marker_injection_fim,
    "op12_rare_token_licences": licences.op12_rare_token_licences,
    "op13_wavelet_search": lexical.op13_wavelet_search,
}

ORACLE_SQL = {
    "op10_prefix_target_chat": chat.ORACLE_SQL,
    "op11_marker_injection_fim": fim.ORACLE_SQL,
    "op12_rare_token_licences": licences.ORACLE_SQL,
    "op13_wavelet_search": lexical.ORACLE_SQL,
}
