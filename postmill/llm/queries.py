"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import exact_dedup, jaccard_join, line_dedup, mixing, order_minhash, packing, quality_rules, ranked_search, repeat_removal, shard_shuffle, toxicity, vector_codes, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_suffix_array_dedup": repeat_removal.op4_suffix_array_dedup,
        "op5_shard_shuffle": shard_shuffle.op5_shard_shuffle,
        "op6_jaccard_join": jaccard_join.op6_jaccard_join,
        "op7_mixing": mixing.op7_mixing,
        "op8_warc": warc.op8_warc,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_packing": packing.op10_packing,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_order_minhash": order_minhash.op13_order_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE, "op6_jaccard_join": jaccard_join.ORACLE, "op8_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE, "op12_ranked_search": ranked_search.ORACLE,
    }
