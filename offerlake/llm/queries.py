"""The registered queries of this package and their SQL."""

from __future__ import annotations

from offerlake.llm import (bpe, decontaminate, fill_middle, language_id, license_scan, ngram_join, packing, prefix_trie,
                           secret_scan, stream_dedup, token_shards, toxicity, warc)

QUERIES = {
    "op1_licenses": license_scan.op1,
    "op2_bpe": bpe.op2,
    "op3_token_shards": token_shards.op3,
    "op4_language_id": language_id.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_warc": warc.op7,
    "op8_toxicity": toxicity.op8,
    "op9_stream_dedup": stream_dedup.op9,
    "op10_secrets": secret_scan.op10,
    "op11_fill_middle": fill_middle.op11,
    "op12_prefix_trie": prefix_trie.op12,
    "op13_packing": packing.op13,
}

ORACLE_SQL = {
    "op1_licenses": license_scan.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op6_decontaminate": decontaminate.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_stream_dedup": stream_dedup.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
