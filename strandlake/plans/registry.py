"""``@query`` collects a Spark callable and, where SQL can say it, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.plans.fixtures import Fixtures, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULE_OF: dict[str, str] = {}
FUNCTIONS: dict[str, Callable[[Fixtures], DataFrame]] = {}
CTES: dict[str, tuple[str, str | None]] = {}


def query(name: str, ctes: str = "", oracle: str | None = None):
    def wrap(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        FUNCTIONS[name], CTES[name] = fn, (ctes, oracle)
        MODULE_OF[name] = fn.__module__.rsplit(".", 1)[-1]
        if oracle is not None:
            ORACLES[name] = with_ctes(ctes, oracle)
        return fn

    return wrap
