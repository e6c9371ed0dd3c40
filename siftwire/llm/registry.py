"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, codes, jaccard, language, lm, mixing, quality, ranking, secrets, shard, tokens, toxicity, vectors


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_lm_score": lm.op2_lm_score,
        "op3_language_id": language.op3_language_id,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_shard_bytes": shard.op6_shard_bytes,
        "op7_bpe": bpe.op7_bpe,
        "op8_jaccard_join": jaccard.op8_jaccard_join,
        "op9_near_vectors": vectors.op9_near_vectors,
        "op10_mix_sources": mixing.op10_mix_sources,
        "op11_vector_codes": codes.op11_vector_codes,
        "op12_lexical_search": ranking.op12_lexical_search,
        "op13_token_files": tokens.op13_token_files,
    }


def oracle_sql() -> dict:
    return {"op5_quality_rules": quality.SQL, "op8_jaccard_join": jaccard.SQL, "op9_near_vectors": vectors.SQL, "op10_mix_sources": mixing.SQL, "op11_vector_codes": codes.SQL, "op12_lexical_search": ranking.SQL}
