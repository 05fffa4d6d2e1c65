"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, language_id, line_dedup, lm_scoring, packing, simhash, token_store, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": url_filter.op1_url_filters,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_nearest": ann.op3_nearest,
        "op4_simhash": simhash.op4_simhash,
        "op5_warc": warc.op5_warc,
        "op6_packing": packing.op6_packing,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_language_id": language_id.op8_language_id,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_token_output": token_store.op10_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.OP1_SQL,
        "op2_line_dedup": line_dedup.OP2_SQL,
        "op5_warc": warc.OP5_SQL,
        "op7_decontamination": decontaminate.OP7_SQL,
    }
