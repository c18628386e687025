"""Queries of this subpackage by name, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_rotation, decontaminate, language_cnn, line_dedup, near_dup, ngram_rules, quality_model, secret_ledger, sentence_pieces, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": token_store.op1_token_store,
    "op2_secret_ledger": secret_ledger.op2_secret_ledger,
    "op3_near_dup": near_dup.op3_near_dup,
    "op4_quality": quality_model.op4_quality,
    "op5_language": language_cnn.op5_language,
    "op6_ngram_rules": ngram_rules.op6_ngram_rules,
    "op7_sentence_pieces": sentence_pieces.op7_sentence_pieces,
    "op8_chat_rotation": chat_rotation.op8_chat_rotation,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op2_secret_ledger": secret_ledger.ORACLE,
    "op3_near_dup": near_dup.ORACLE,
    "op8_chat_rotation": chat_rotation.ORACLE,
}
