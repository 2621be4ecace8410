"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from meridian.llm import byte_bpe, centroids, ibl_sketch, importance, line_dedup, media, minhash_dedup, mixing, ngram_lm, prefix_trie, simhash_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_importance_resampling": importance.op1_importance_resampling,
    "op2_source_mix": mixing.op2_source_mix,
    "op3_lm_scores": ngram_lm.op3_lm_scores,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_byte_bpe": byte_bpe.op5_byte_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_media_columns": media.op7_media_columns,
    "op8_simhash_dedup": simhash_dedup.op8_simhash_dedup,
    "op9_ibl_sketch": ibl_sketch.op9_ibl_sketch,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_minhash_dedup": minhash_dedup.op12_minhash_dedup,
    "op13_centroid_clustering": centroids.op13_centroid_clustering,
}

SQL = {
    "op2_source_mix": mixing.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op12_minhash_dedup": minhash_dedup.OP12_SQL,
    "op13_centroid_clustering": centroids.OP13_SQL,
}
