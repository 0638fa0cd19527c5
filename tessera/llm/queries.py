"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, chat_format, language_model, media, packing, quality_classifier, quality_rules, secrets_scan, simhash, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_simhash": simhash.op2_simhash,
        "op3_language_model": language_model.op3_language_model,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_media": media.op6_media,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_secrets": secrets_scan.op8_secrets,
        "op9_packing": packing.op9_packing,
        "op10_quality_rules": quality_rules.op10_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": chat_format.OP4_SQL}
