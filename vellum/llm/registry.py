"""The corpus queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import digest_dedup, hilbert_ann, hmm_score, html_text, mixing, near_dedup, packing, shards, warc, weak_quality

QUERIES = {
    "op1_suffix_array_text": html_text.op1_suffix_array_text,
    "op2_indexed_warc": warc.op2_indexed_warc,
    "op3_hmm_scores": hmm_score.op3_hmm_scores,
    "op4_digest_dedup": digest_dedup.op4_digest_dedup,
    "op5_minhash_components": near_dedup.op5_minhash_components,
    "op6_complement_packing": packing.op6_complement_packing,
    "op7_pivotal_mix": mixing.op7_pivotal_mix,
    "op10_weak_label_quality": weak_quality.op10_weak_label_quality,
    "op8_hypergeometric_shards": shards.op8_hypergeometric_shards,
    "op9_hilbert_neighbours": hilbert_ann.op9_hilbert_neighbours,
}

SQL = {
    "op2_indexed_warc": warc.OP2_SQL,
    "op4_digest_dedup": digest_dedup.OP4_SQL,
    "op9_hilbert_neighbours": hilbert_ann.OP9_SQL,
}
