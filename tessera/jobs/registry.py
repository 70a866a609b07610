"""Every scenery query with the SQL it is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.shipping import ship_package
from tessera.sources.fixtures import with_inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *inputs: str) -> Callable[[Query], Query]:
    """Registers a query, and SQL over the given tables and the named derived inputs that must return the same rows."""

    def register(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = with_inputs(sql, *inputs) if inputs else sql
        return run

    return register


from tessera.jobs import airport_jobs, ground_jobs, network_jobs, point_jobs, polygon_jobs, raster_jobs, rule_jobs, scenery_jobs, source_jobs, terrain_jobs, vector_jobs  # noqa: E402, F401
