"""Queries and SQL of the corpus operators, for the repository's entry module."""

from __future__ import annotations

from . import decontamination, embedding_dedup, jaccard_join, langid, line_dedup, packing, sharding, substring_dedup, toxicity, url_reputation

QUERIES = {
    "op1_ngram_jaccard_join": jaccard_join.op1_ngram_jaccard_join,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_suffix_dedup": substring_dedup.op3_suffix_dedup,
    "op4_language_id": langid.op4_language_id,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_url_reputation": url_reputation.op6_url_reputation,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_hilbert_sharding": sharding.op9_hilbert_sharding,
}
ORACLE_SQL = {
    "op5_line_dedup": line_dedup.SQL,
    "op6_url_reputation": url_reputation.SQL,
}
