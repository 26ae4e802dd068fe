"""The queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard, language_id, mixing, pii, suffix_dedup, telephony, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (decontamination.op1_decontamination, jaccard.op2_jaccard_join, mixing.op3_mixing, warc.op4_warc, url_filter.op5_url_filter, telephony.op6_telephony, pii.op7_pii, toxicity.op8_toxicity, suffix_dedup.op9_suffix_dedup, language_id.op10_language_id)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": jaccard.ORACLE, "op3_mixing": mixing.ORACLE, "op4_warc": warc.ORACLE, "op5_url_filter": url_filter.ORACLE}
