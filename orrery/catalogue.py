"""All queries of the library outside orrery.llm, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orrery.plans import batches, bundles, claims, contracts, dialogues, layouts, metrics, rasters, registry, releases, reviews, samples, scenes, seen, spatial, tasks, texts  # noqa: F401  modules register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
