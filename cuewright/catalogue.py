"""The query catalogue: name -> (query, DuckDB equivalent)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuewright.plans import editing, media, registry, review, surfaces, transcripts, whole_clips  # noqa: F401  (they register their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
