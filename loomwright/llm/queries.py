"""The queries of this package, with the SQL that some of them are compared with."""

from . import decontam, jaccard, langid, langmodel, mixing, quality, secrets, sharding, tokens, toxicity

QUERIES = {
    "op1_token_files": tokens.op1,
    "op2_mix_sources": mixing.op2,
    "op3_language_id": langid.op3,
    "op4_secret_scan": secrets.op4,
    "op5_jump_shards": sharding.op5,
    "op6_decontaminate": decontam.op6,
    "op7_language_model": langmodel.op7,
    "op8_toxicity_chain": toxicity.op8,
    "op9_jaccard_join": jaccard.op9,
    "op10_quality_rules": quality.op10,
}
ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op5_jump_shards": sharding.ORACLE,
    "op6_decontaminate": decontam.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
