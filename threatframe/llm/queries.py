"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from threatframe.llm import conversations, exact_dedup, langid, mixing, near_dedup, packing, quality_model, quality_rules, sharding, substring_dedup, toxicity, warc, whitening


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_boosted_toxicity": toxicity.op2_boosted_toxicity,
        "op9_nbsvm_quality": quality_model.op9_nbsvm_quality,
        "op3_suffix_repetition": quality_rules.op3_suffix_repetition,
        "op5_best_two_fit": packing.op5_best_two_fit,
        "op4_interleaved_shards": sharding.op4_interleaved_shards,
        "op6_dart_near_dedup": near_dedup.op6_dart_near_dedup,
        "op7_count_min_substrings": substring_dedup.op7_count_min_substrings,
        "op8_byte_convnet_langid": langid.op8_byte_convnet_langid,
        "op10_pivotal_mixing": mixing.op10_pivotal_mixing,
        "op11_bidirectional_repair": conversations.op11_bidirectional_repair,
        "op12_warc_round_trip": warc.op12_warc_round_trip,
        "op13_spectrum_whitening": whitening.op13_spectrum_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.OP1_SQL, "op3_suffix_repetition": quality_rules.OP3_SQL, "op6_dart_near_dedup": near_dedup.OP6_SQL, "op7_count_min_substrings": substring_dedup.OP7_SQL, "op11_bidirectional_repair": conversations.OP11_SQL, "op12_warc_round_trip": warc.OP12_SQL}
