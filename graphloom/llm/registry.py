"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from graphloom.llm import chat, decontaminate, fingerprint, html, langid, minhash, mixing, quality, sharding, urls

QUERIES = {
    "op1_soft_mixing": mixing.op1_soft_mixing,
    "op2_latent_leaks": decontaminate.op2_latent_leaks,
    "op3_virtual_slots": sharding.op3_virtual_slots,
    "op4_content_chunks": fingerprint.op4_content_chunks,
    "op5_dart_minhash": minhash.op5_dart_minhash,
    "op6_tag_path_ratio": html.op6_tag_path_ratio,
    "op7_ordinal_quality": quality.op7_ordinal_quality,
    "op8_string_kernel": langid.op8_string_kernel,
    "op9_chat_format": chat.op9_chat_format,
    "op10_url_ratio": urls.op10_url_ratio,
}

ORACLE = {
    "op9_chat_format": chat.OP9_SQL,
    "op10_url_ratio": urls.OP10_SQL,
}
