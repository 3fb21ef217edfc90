"""How queries are registered: sources in SQL that both engines read, an operator, and DuckDB's SQL for its rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliate.sources.tables import select

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(sql: str) -> str:
    """A source's SQL without the braces around table names."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def register(name: str, sources: dict[str, str], build: Callable[..., DataFrame], sql: str | None) -> None:
    """``build`` gets a DataFrame for each source, in order; ``sql`` sees them as common table expressions of the same names."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(*(select(spark, sf_dir, s) for s in sources.values()))

    run.__doc__ = build.__doc__
    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({plain(s)})" for k, s in sources.items()) + "\n" + sql
