"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import bpe, collocations, fingerprints, mpeg_audio, near_dups, ngram_trie, packing, pii, prefix_trie, quality, sharding, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_fingerprints": fingerprints.op4_fingerprints,
    "op5_media_columns": mpeg_audio.op5_media_columns,
    "op6_near_dedup": near_dups.op6_near_dedup,
    "op7_quality": quality.op7_quality,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_pii": pii.op9_pii,
    "op10_bpe": bpe.op10_bpe,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_lm_scores": ngram_trie.op12_lm_scores,
    "op13_collocations": collocations.op13_collocations,
}

ORACLES: dict[str, str] = {"op11_prefix_trie": prefix_trie.OP11_SQL, "op13_collocations": collocations.OP13_SQL}
