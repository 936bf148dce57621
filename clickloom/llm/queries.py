"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from clickloom.llm import (
    ann, decontaminate, hard_negatives, langid, line_dedup, lm_score, packing, quality, sharding, simhash, token_counts, toxicity,
    vector_codes,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": langid.op3_language_id,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_sharding": sharding.op6_sharding,
    "op7_lm_scoring": lm_score.op7_lm_scoring,
    "op7_lm_scoring_order3": lm_score.op7_lm_scoring_order3,
    "op8_packing": packing.op8_packing,
    "op9_approximate_nearest_neighbours": ann.op9_approximate_nearest_neighbours,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

#: The others train a model, tokenise, search a graph, follow links of any length or iterate to a fixed number of rounds
#: with data-dependent codebooks, which SQL does not express; op11 is tested against a brute-force version.
ORACLE = {
    "op1_line_dedup": line_dedup.SQL,
    "op7_lm_scoring": lm_score.SQL,
    "op7_lm_scoring_order3": lm_score.SQL_ORDER3,
    "op10_benchmark_decontamination": decontaminate.SQL,
}
