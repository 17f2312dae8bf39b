"""Queries of this subpackage and their SQL, for the driver file."""

from __future__ import annotations

from driftlake.llm import bpe, chat, decontaminate, langid, lm, quality, simhash, suffix_dedup, token_store, warc

_OPS = {
    "op1_suffix_dedup": (suffix_dedup.op1_suffix_dedup, suffix_dedup.SQL),
    "op2_simhash": (simhash.op2_simhash, None),
    "op3_token_store": (token_store.op3_token_store, None),
    "op4_language_id": (langid.op4_language_id, None),
    "op5_chat_format": (chat.op5_chat_format, chat.SQL),
    "op6_decontaminate": (decontaminate.op6_decontaminate, None),
    "op7_lm_score": (lm.op7_lm_score, None),
    "op8_bpe": (bpe.op8_bpe, None),
    "op9_quality_rules": (quality.op9_quality_rules, quality.SQL),
    "op10_warc": (warc.op10_warc, warc.SQL),
}


def queries() -> dict:
    return {name: f for name, (f, _) in _OPS.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _OPS.items() if sql}
