"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, divergence, exact, language, lattice, merkle, mixing, ngram_join, quality, secrets, sharding, substring, toxicity

QUERIES = {
    "op1_ngram_jaccard": ngram_join.op1_ngram_jaccard,
    "op2_bpe": bpe.op2_bpe,
    "op3_mix": mixing.op3_mix,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_feistel_shards": sharding.op5_feistel_shards,
    "op6_lattice_score": lattice.op6_lattice_score,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_language_id": language.op9_language_id,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_substring_dedup": substring.op13_substring_dedup,
}

SQL = {
    "op1_ngram_jaccard": ngram_join.OP1_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_exact_dedup": exact.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_substring_dedup": substring.OP13_SQL,
}
