"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, langid, line_dedup, mixing, near_dups, neighbours, packing, quality, secrets, suffix_tree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_tree": suffix_tree.op1_suffix_tree,
        "op2_html_text": html_text.op2_html_text,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_secrets": secrets.op4_secrets,
        "op5_packing": packing.op5_packing,
        "op6_near_dups": near_dups.op6_near_dups,
        "op7_language_id": langid.op7_language_id,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_quality": quality.op9_quality,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op10_mixing": mixing.OP10_SQL}
