"""Operators of a training-data pipeline. Nothing else in the package imports this one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.llm import license_scan, line_dedup, mixing, multi_index, near_dup, packing, quality, secret_scan, vector_dedup, warc_fixity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_nbsvm": quality.op1_quality_nbsvm,
        "op2_sequence_packing": packing.op2_sequence_packing,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_multi_index": multi_index.op4_multi_index,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_warc_fixity": warc_fixity.op6_warc_fixity,
        "op7_minhash_near_dup": near_dup.op7_minhash_near_dup,
        "op8_source_mix": mixing.op8_source_mix,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_vector_near_dup": vector_dedup.op10_vector_near_dup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_fixity": warc_fixity.SQL, "op9_license_scan": license_scan.sql()}
