"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontamination, embeddings, html_text, language_model, merkle, ngram_join, packing, phrases, quality_rules, suffix_dedup, token_files, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_html_text": html_text.op2_html_text,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_language_model": language_model.op5_language_model,
        "op6_token_files": token_files.op6_token_files,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_packing": packing.op8_packing,
        "op9_decontamination": decontamination.op9_decontamination,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_embedding_dedup": embeddings.op11_embedding_dedup,
        "op12_phrase_mining": phrases.op12_phrase_mining,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": chat.SQL, "op11_embedding_dedup": embeddings.SQL, "op12_phrase_mining": phrases.SQL, "op13_merkle_manifest": merkle.SQL}
