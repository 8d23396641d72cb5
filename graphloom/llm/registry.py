"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact, mixing, quality, simhash, substrings, suffixes, tokencounts, tokenfile, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontamination": decontaminate.op3_decontamination,
        "op4_token_counts": tokencounts.op4_token_counts,
        "op5_suffix_dedup": suffixes.op5_suffix_dedup,
        "op6_token_output": tokenfile.op6_token_output,
        "op7_exact_dedup": exact.op7_exact_dedup,
        "op8_simhash": simhash.op8_simhash,
        "op9_substring_dedup": substrings.op9_substring_dedup,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.OP1_SQL, "op7_exact_dedup": exact.OP7_SQL}
