"""Queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from strata.llm import bpe, chroma, minhash, packing, pfor, prefixtree, quality, sharding, streamdedup, toxicity, urllists, wavelet, windows

QUERIES = {
    "op1_quality_cascade": quality.op1_quality_cascade,
    "op2_chroma_prints": chroma.op2_chroma_prints,
    "op3_temporal_list": urllists.op3_temporal_list,
    "op4_compact_windows": windows.op4_compact_windows,
    "op5_bpe_lexicon": bpe.op5_bpe_lexicon,
    "op6_subword_toxicity": toxicity.op6_subword_toxicity,
    "op7_pfor_blocks": pfor.op7_pfor_blocks,
    "op8_slack_packing": packing.op8_slack_packing,
    "op9_feistel_shards": sharding.op9_feistel_shards,
    "op10_circulant_minhash": minhash.op10_circulant_minhash,
    "op11_stream_dedup": streamdedup.op11_stream_dedup,
    "op12_prefix_tree": prefixtree.op12_prefix_tree,
    "op13_wavelet_search": wavelet.op13_wavelet_search,
}

ORACLE_SQL = {
    "op1_quality_cascade": quality.op1_sql(),
    "op3_temporal_list": urllists.OP3_SQL,
    "op9_feistel_shards": sharding.op9_sql(),
    "op10_circulant_minhash": minhash.OP10_SQL,
    "op11_stream_dedup": streamdedup.OP11_SQL,
    "op12_prefix_tree": prefixtree.OP12_SQL,
    "op13_wavelet_search": wavelet.OP13_SQL,
}
