"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, decontamination, filteraudit, fingerprints, hardnegatives, mixing, ngramjoin, quality, rollups, tokenstore, toxicity, vectors, warc

QUERIES = {
    "op1_near_duplicate_vectors": vectors.op1,
    "op2_token_store": tokenstore.op2,
    "op3_ngram_components": ngramjoin.op3,
    "op4_fingerprints": fingerprints.op4,
    "op5_source_mix": mixing.op5,
    "op6_bpe_round_trip": bpe.op6,
    "op7_warc_transactions": warc.op7,
    "op8_toxicity_scores": toxicity.op8,
    "op9_quality_scores": quality.op9,
    "op10_token_rollups": rollups.op10,
    "op11_benchmark_overlap": decontamination.op11,
    "op12_filter_audit": filteraudit.op12,
    "op13_hard_negatives": hardnegatives.op13,
}
ORACLES = {
    "op1_near_duplicate_vectors": vectors.OP1_SQL,
    "op5_source_mix": mixing.OP5_SQL,
    "op11_benchmark_overlap": decontamination.OP11_SQL,
    "op12_filter_audit": filteraudit.OP12_SQL,
    "op13_hard_negatives": hardnegatives.OP13_SQL,
}
