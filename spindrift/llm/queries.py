"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, language_id, log_bilinear, merkle, mixing, packing, phrases, quality_knn, quality_rules, sharding, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_quality_knn": quality_knn.op2_quality_knn,
        "op3_language_id": language_id.op3_language_id,
        "op4_exact_dedup": exact_dedup.op4_exact_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_sharding": sharding.op7_sharding,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_mixing": mixing.op10_mixing,
        "op11_language_model": log_bilinear.op11_language_model,
        "op12_phrases": phrases.op12_phrases,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": exact_dedup.OP4_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op7_sharding": sharding.OP7_SQL,
        "op8_suffix_dedup": suffix_dedup.OP8_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
        "op10_mixing": mixing.OP10_SQL,
        "op12_phrases": phrases.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
