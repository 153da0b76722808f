"""All queries of the subpackage; importing the query module fills the registry."""

from __future__ import annotations

from ledgerloom.llm import queries as _queries  # noqa: F401
from ledgerloom.llm.registry import ORACLES, QUERIES
from ledgerloom.session import ensure_settings


def queries():
    def prepared(fn):
        def run(spark, sf_dir):
            ensure_settings(spark)
            return fn(spark, sf_dir)

        return run

    return {name: prepared(fn) for name, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
