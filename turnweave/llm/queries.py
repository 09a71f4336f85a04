"""Registered queries of this package: name -> (query, SQL or None)."""

from __future__ import annotations

from turnweave.llm import (
    op_bpe,
    op_cells,
    op_chat,
    op_divergence,
    op_media,
    op_mixture,
    op_near,
    op_pack,
    op_pii,
    op_quality,
    op_substring,
    op_suffix,
    op_trie,
)

QUERIES = {
    "op1_embedding_near_dedup": (op_cells.op1_embedding_near_dedup, op_cells.SQL),
    "op2_suffix_array_dedup": (op_suffix.op2_suffix_array_dedup, None),
    "op3_byte_bpe": (op_bpe.op3_byte_bpe, None),
    "op4_best_fit_packing": (op_pack.op4_best_fit_packing, None),
    "op5_pii_surrogates": (op_pii.op5_pii_surrogates, None),
    "op6_transport_streams": (op_media.op6_transport_streams, None),
    "op7_chat_windows": (op_chat.op7_chat_windows, None),
    "op9_minhash_near_dedup": (op_near.op9_minhash_near_dedup, op_near.SQL),
    "op8_substring_dedup": (op_substring.op8_substring_dedup, op_substring.SQL),
    "op10_quality_classifier": (op_quality.op10_quality_classifier, None),
    "op11_source_divergence": (op_divergence.op11_source_divergence, op_divergence.SQL),
    "op12_conversation_trie": (op_trie.op12_conversation_trie, op_trie.SQL),
    "op13_source_mixture": (op_mixture.op13_source_mixture, None),
}
