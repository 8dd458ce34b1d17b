"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tempora.llm import katz, line_dedup, merkle, mixing, packing, pii, quality, simhash, topk, warc

QUERIES = {
    "op1_skip_chain_pii": pii.op1,
    "op10_katz_backoff": katz.op10,
    "op2_best_fit_packing": packing.op2,
    "op3_merkle_fingerprints": merkle.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_exact_top_k": topk.op5,
    "op6_mixing": mixing.op6,
    "op7_line_dedup": line_dedup.op7,
    "op8_warc": warc.op8,
    "op9_quality_classifier": quality.op9,
}

ORACLES = {
    "op5_exact_top_k": topk.OP5_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
}
