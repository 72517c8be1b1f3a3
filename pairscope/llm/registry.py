"""The queries of this folder and the SQL that states the same results."""

from __future__ import annotations

from pairscope.llm import decontaminate, langid, lmscore, mixing, packing, pii, quality, quotes, rolling, simhash, substrings, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_contextual_pii": pii.op3,
    "op4_quotation_linking": quotes.op4,
    "op5_quality_rules": quality.op5,
    "op6_cross_entropy_difference": lmscore.op6,
    "op7_simhash_near_dedup": simhash.op7,
    "op8_hierarchical_packing": packing.op8,
    "op9_language_codes": langid.op9,
    "op10_phrase_automata": substrings.op10,
    "op11_rolling_users": rolling.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_pareto_mixing": mixing.op13,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.OP2_SQL,
    "op4_quotation_linking": quotes.OP4_SQL,
    "op5_quality_rules": quality.op5_sql(),
    "op11_rolling_users": rolling.OP11_SQL,
    "op13_pareto_mixing": mixing.OP13_SQL,
}
