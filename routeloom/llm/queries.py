"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, langid, line_dedup, media, packing, quality, simhash, suffix_dedup, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (packing.op1_packing, quality.op2_quality, url_filter.op3_url_filter, line_dedup.op4_line_dedup, suffix_dedup.op5_suffix_dedup, decontaminate.op6_decontaminate, langid.op7_langid, toxicity.op8_toxicity, simhash.op9_simhash, media.op10_media)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.sql(), "op4_line_dedup": line_dedup.sql()}
