"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from inkwell.llm import ann, bpe, exact_dedup, licenses, mixing, near_dedup, pii, quality, secrets, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_bpe": bpe.op2_bpe,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_licenses": licenses.op6_licenses,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_mix": mixing.op8_mix,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_quality": quality.op10_quality,
}

#: The others hold learned scores, Spark's own hashes (op8's seeded order), patterns with look-around and possessive parts (op5's base
#: spans), token ids or all pairs of whole texts: tests/llm compares them with brute force.
SQL = {"op7_exact_dedup": exact_dedup.OP7_SQL}
