"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import alignment, importance, jaccard_join, language_model, packing, permutation_index, pii, quality, secret_scan, sentencepiece_codec, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_bm25_packing": packing.op2_bm25_packing,
    "op3_crf": pii.op3_crf,
    "op4_pitman_yor": language_model.op4_pitman_yor,
    "op5_hash_tree": sharding.op5_hash_tree,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_rlz": substring_dedup.op7_rlz,
    "op8_permutation_index": permutation_index.op8_permutation_index,
    "op9_parity_sketch": jaccard_join.op9_parity_sketch,
    "op10_digest_cache": token_counts.op10_digest_cache,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_byte_owners": alignment.op12_byte_owners,
    "op13_randomness_tests": secret_scan.op13_randomness_tests,
}
ORACLE_SQL = {**quality.SQL, **sharding.SQL, **importance.SQL, **secret_scan.SQL}
