"""All queries of the library by name, with the SQL that an oracle runs beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docassay.plans import credit, evaluation, fusion, generated, identity, reports, summaries, text  # noqa: F401  they register their queries
from docassay.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
