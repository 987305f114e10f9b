"""Every query of the catalogue and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerweave.plans import actions, decisions, events, governance, layout, provenance, quality, sources, typing, validation  # noqa: F401  each registers its queries
from ledgerweave.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
