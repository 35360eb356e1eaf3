"""Registration of queries: a function of the model, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import VIEWS, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``f(model)`` under ``name``; ``sql`` may use every bound view."""

    def put(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if sql:
            views = ", ".join(f"{k} AS ({v})" for k, v in VIEWS.items())
            head, body = ("WITH RECURSIVE", sql.strip().removeprefix("WITH RECURSIVE").removeprefix("WITH"))
            glue = ", " if sql.strip().startswith("WITH") else " "
            ORACLES[name] = f"{head} {views}{glue}{body.strip()}"
        return f

    return put
