"""Queries of this subpackage by name, with their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from tidelog.llm import byte_bpe, chat_format, exact_dedup, fingerprints, html_text, language_id, ngram_join, packing, sharding, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_byte_bpe": byte_bpe.op3_byte_bpe,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_sharding": sharding.op5_sharding,
        "op6_packing": packing.op6_packing,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_html_text": html_text.op9_html_text,
        "op10_ngram_join": ngram_join.op10_ngram_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op7_chat_format": chat_format.ORACLE_SQL, "op10_ngram_join": ngram_join.ORACLE_SQL}
