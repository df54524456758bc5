"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from . import cover_tree, decontaminate, importance, licences, minhash_dedup, mixing, suffix_dedup, token_counts, warc, wrapper

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_cgk_decontamination": decontaminate.op2,
    "op3_linear_token_counts": token_counts.op3,
    "op4_cover_tree_search": cover_tree.op4,
    "op5_pareto_mixing": mixing.op5,
    "op6_wrapper_induction": wrapper.op6,
    "op7_minhash_dedup": minhash_dedup.op7,
    "op8_warc_bundles": warc.op8,
    "op9_importance_classifier": importance.op9,
    "op10_licence_scan": licences.op10,
}
ORACLES: dict[str, str] = {
    "op4_cover_tree_search": cover_tree.OP4_SQL,
    "op5_pareto_mixing": mixing.OP5_SQL,
    "op8_warc_bundles": warc.OP8_SQL,
    "op10_licence_scan": licences.OP10_SQL,
}
