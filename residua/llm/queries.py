"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from residua.llm import html, importance, jaccard, licenses, media, mixing, packing, rules, sharding, toxicity

QUERIES = {
    "op1_chunked_media": media.op1_chunked_media,
    "op2_importance_resampling": importance.op2_importance_resampling,
    "op3_systematic_mix": mixing.op3_systematic_mix,
    "op4_wrapper_induction": html.op4_wrapper_induction,
    "op5_boosted_rules": rules.op5_boosted_rules,
    "op6_counterfactual_toxicity": toxicity.op6_counterfactual_toxicity,
    "op7_signature_trees": jaccard.op7_signature_trees,
    "op8_length_buckets": packing.op8_length_buckets,
    "op9_license_rules": licenses.op9_license_rules,
    "op10_virtual_slots": sharding.op10_virtual_slots,
}
ORACLES = {"op3_systematic_mix": mixing.OP3_SQL, "op9_license_rules": licenses.OP9_SQL}
