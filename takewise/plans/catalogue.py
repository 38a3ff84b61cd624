"""All queries over the reference's operators, with their SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compare, files, notes, results, scores, signal, songs


MODULES = (notes, signal, scores, results, files, compare, songs)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.QUERIES["pitch_metrics"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
