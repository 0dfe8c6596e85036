"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, hard_negatives, language, license_scan, packing, pii, quality, simhash, spelling, substring, topk, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_simhash": simhash.op2_simhash,
        "op4_packing": packing.op4_packing,
        "op5_pii": pii.op5_pii,
        "op3_byte_bpe": bpe.op3_byte_bpe,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_topk": topk.op7_topk,
        "op8_licenses": license_scan.op8_licenses,
        "op9_chat": chat.op9_chat,
        "op10_substring": substring.op10_substring,
        "op11_spelling": spelling.op11_spelling,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_language": language.op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": topk.OP7_SQL, "op9_chat": chat.OP9_SQL, "op12_hard_negatives": hard_negatives.OP12_SQL}
