"""Every operator's query by name, and the statements SQL can express."""

from __future__ import annotations

from scriptledger.llm import (
    op1_surrogates,
    op2_suffix_tree,
    op3_quality,
    op4_fingerprints,
    op5_topk,
    op6_jaccard,
    op7_mixing,
    op8_bpe,
    op9_substrings,
    op10_sharding,
    op11_manifest,
    op12_negatives,
    op13_token_counts,
)

QUERIES = {
    "op1_keyed_surrogates": op1_surrogates.query,
    "op2_probabilistic_suffix_tree": op2_suffix_tree.query,
    "op3_neighbour_vote_quality": op3_quality.query,
    "op4_improbable_feature_digest": op4_fingerprints.query,
    "op5_norm_bucketed_topk": op5_topk.query,
    "op6_parity_sketch_join": op6_jaccard.query,
    "op7_entropy_balanced_mix": op7_mixing.query,
    "op8_byte_level_bpe": op8_bpe.query,
    "op9_count_min_substrings": op9_substrings.query,
    "op10_hypergeometric_shards": op10_sharding.query,
    "op11_incremental_witnesses": op11_manifest.query,
    "op12_angular_negatives": op12_negatives.query,
    "op13_distinct_token_counts": op13_token_counts.query,
}

SQL: dict[str, str] = {
    "op5_norm_bucketed_topk": op5_topk.SQL,
    "op6_parity_sketch_join": op6_jaccard.SQL,
    "op9_count_min_substrings": op9_substrings.SQL,
    "op11_incremental_witnesses": op11_manifest.SQL,
    "op12_angular_negatives": op12_negatives.SQL,
}
