"""Queries of this subpackage, and the SQL that must give the same rows."""

from __future__ import annotations

from plumbline.llm import bpe_codec, exact_dedup, fingerprints, langid, lm_score, ngram_join, packing, pii, sharding, token_counts

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_sharding": sharding.op3_sharding,
    "op4_packing": packing.op4_packing,
    "op5_bpe_codec": bpe_codec.op5_bpe_codec,
    "op6_pii": pii.op6_pii,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_langid": langid.op9_langid,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
}
ORACLES = {"op2_ngram_join": ngram_join.ORACLE, "op10_exact_dedup": exact_dedup.ORACLE}
