"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, fixity, langid, mixing, neardup, packing, passages, prefixes, quality, secrets, spelling, topk

QUERIES = {
    "op1_chat_prefix_targets": chat.op1_chat_prefix_targets,
    "op2_quality_ledger": quality.op2_quality_ledger,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_repeated_passages": passages.op4_repeated_passages,
    "op5_histogram_topk": topk.op5_histogram_topk,
    "op6_merkle_fixity": fixity.op6_merkle_fixity,
    "op7_hamming_near_duplicates": neardup.op7_hamming_near_duplicates,
    "op8_language_id": langid.op8_language_id,
    "op9_bin_slack_packing": packing.op9_bin_slack_packing,
    "op10_secret_spans": secrets.op10_secret_spans,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_prefix_trie": prefixes.op12_prefix_trie,
    "op13_apportioned_mix": mixing.op13_apportioned_mix,
}
ORACLES: dict[str, str] = {
    "op1_chat_prefix_targets": chat.ORACLE,
    "op2_quality_ledger": quality.ORACLE,
    "op5_histogram_topk": topk.ORACLE,
    "op6_merkle_fixity": fixity.ORACLE,
    "op7_hamming_near_duplicates": neardup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_prefix_trie": prefixes.ORACLE,
    "op13_apportioned_mix": mixing.ORACLE,
}
