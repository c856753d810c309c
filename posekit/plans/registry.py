"""Registered queries and their DuckDB equivalents.

A query is registered with the views it reads and the double columns that both
sides round to nine decimals. The package imports all modules of queries, which
fills QUERIES and ORACLES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posekit.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "p2_per_fly_speed"


def query(name: str, reads: str, sql: str | None = None, doubles: str = "", digits: int = 9):
    """Register f(*views) under name; sql may use the same views by name. digits: decimals of the doubles (fewer after long sums and steep scales)."""
    names, rounded = reads.split(), doubles.split()

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(*[views.load(spark, sf_dir, v) for v in names])
            return out.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in rounded}) if rounded else out

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql is not None:
            body = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) + 0.0 AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
            ORACLES[name] = views.with_views(names, body)
        return f

    return add
