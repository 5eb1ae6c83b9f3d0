"""Named queries with the SQL that should give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadlab.catalog.oracle_parts import compose
from spreadlab.plans.bindings import Bindings
from spreadlab.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = "", ctes: str = ""):
    """Register a query; `uses` names the shared SQL parts its oracle reads."""

    def add(fn: Callable[[Bindings], DataFrame]):
        if name in QUERIES:
            raise KeyError(name)

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Bindings(prepare(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = compose(uses.split(), ctes, sql)
        return fn

    return add
