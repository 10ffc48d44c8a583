"""Queries of the text operators and the SQL that checks them."""

from cohortry.llm import (alignment, byte_bpe, divergence, exact_dedup, langid, line_chunks, mixing,
                          pieces, quality, simhash, suffix_tree, topk, toxicity)

QUERIES = {
    "op1_piece_sampling": pieces.op1_piece_sampling,
    "op2_entropy_mix": mixing.op2_entropy_mix,
    "op3_nbsvm": quality.op3_nbsvm,
    "op4_ordinal_toxicity": toxicity.op4_ordinal_toxicity,
    "op5_simhash_bytes": simhash.op5_simhash_bytes,
    "op6_norm_sorted_topk": topk.op6_norm_sorted_topk,
    "op7_digest_index": exact_dedup.op7_digest_index,
    "op8_line_chunks": line_chunks.op8_line_chunks,
    "op9_suffix_tree": suffix_tree.op9_suffix_tree,
    "op10_centroid_langid": langid.op10_centroid_langid,
    "op11_word_shuffle_bpe": byte_bpe.op11_word_shuffle_bpe,
    "op12_text_alignment": alignment.op12_text_alignment,
    "op13_run_length_audit": divergence.op13_run_length_audit,
}

ORACLE = {
    "op6_norm_sorted_topk": topk.OP6_SQL,
    "op7_digest_index": exact_dedup.OP7_SQL,
    "op8_line_chunks": line_chunks.OP8_SQL,
    "op13_run_length_audit": divergence.OP13_SQL,
}
