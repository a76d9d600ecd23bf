"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from plumbline.llm import block_names, bpe, chat, langid, licenses, merkle, packing, resampling, simhash, substring_dedup, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_langid": langid.op3_langid,
    "op4_bpe": bpe.op4_bpe,
    "op5_pack": packing.op5_pack,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_chat_format": chat.op7_chat_format,
    "op8_simhash": simhash.op8_simhash,
    "op9_topk": topk.op9_topk,
    "op10_exact_dedup": block_names.op10_exact_dedup,
    "op11_merkle": merkle.op11_merkle,
    "op12_licenses": licenses.op12_licenses,
    "op13_resampling": resampling.op13_resampling,
}
SQL = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op7_chat_format": chat.ORACLE,
    "op9_topk": topk.ORACLE,
    "op10_exact_dedup": block_names.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_resampling": resampling.ORACLE,
}
