"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import byte_bpe, divergence, embedding_dedup, fill_middle, ngram_join, packing, rule_ensemble, sharding, source_audit, substring_dedup, syncmers, toxicity, url_rules

QUERIES = {
    "op1_divergence": divergence.op1_divergence,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_rule_ensemble": rule_ensemble.op3_rule_ensemble,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_packing": packing.op5_packing,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_shards": sharding.op9_shards,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_syncmer_fingerprints": syncmers.op13_syncmer_fingerprints,
}
ORACLES = {
    "op1_divergence": divergence.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op7_ngram_jaccard": ngram_join.SQL,
    "op8_url_rules": url_rules.SQL,
    "op9_shards": sharding.SQL,
    "op10_embedding_dedup": embedding_dedup.SQL,
    "op11_fill_in_middle": fill_middle.SQL,
    "op12_source_audit": source_audit.SQL,
}
