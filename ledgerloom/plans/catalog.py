"""All registered queries; importing the query modules fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import account_queries, completeness_queries, integrity_queries, label_queries, review_queries, rollup_queries, rule_queries, search_queries, source_queries, tax_queries  # noqa: F401
from ledgerloom.plans.registry import ORACLES, QUERIES
from ledgerloom.session import ensure_settings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def prepared(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_settings(spark)
            return fn(spark, sf_dir)

        return run

    return {name: prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
