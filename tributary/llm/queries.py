"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, html, licenses, mixing, near, neighbours, pii, quality, secrets, tokencounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality.op1,
    "op2_html_extraction": html.op2,
    "op3_license_scans": licenses.op3,
    "op4_near_duplicates": near.op4,
    "op5_token_counts": tokencounts.op5,
    "op6_secret_scans": secrets.op6,
    "op7_pii": pii.op7,
    "op8_neighbours": neighbours.op8,
    "op9_mixing": mixing.op9,
    "op10_bpe": bpe.op10,
}

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": quality.ORACLE}
