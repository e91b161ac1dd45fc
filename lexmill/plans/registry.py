"""Queries of the core, with their SQL."""

from __future__ import annotations

from lexmill.plans import metric_queries, numeric_queries, relation_queries, text_queries
from lexmill.session import ship

MODULES = (text_queries, metric_queries, numeric_queries, relation_queries)


def _shipped(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _shipped(f) for m in MODULES for name, f in m.R.queries.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.R.sql.items()}
