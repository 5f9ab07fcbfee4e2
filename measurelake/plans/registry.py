"""The named queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import battery_queries, contrast_queries, further_queries, gate_queries, matching_queries, model_queries, recurrence_queries, relational_queries, source_queries, statistics_queries, survival_queries

_MODULES = (relational_queries, statistics_queries, survival_queries, model_queries, further_queries, matching_queries, contrast_queries, recurrence_queries, battery_queries, source_queries, gate_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned paired contrasts: scan, replicate collapse, pairing, planned rows, fixed-family BH."""
    return statistics_queries.paired_contrast_planned(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql is not None}
