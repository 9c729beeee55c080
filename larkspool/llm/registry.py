"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from . import decontam, fingerprint, langid, lm, packing, sharding, simhash, suffixdedup, toxicity

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
    "op10_decontamination": decontam.op10_decontamination,
    "op2_simhash": simhash.op2_simhash,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_language_id": langid.op8_language_id,
    "op3_token_binary": packing.op3_token_binary,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op9_global_shuffle": sharding.op9_global_shuffle,
}
ORACLES: dict[str, str] = {}


def queries():
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
