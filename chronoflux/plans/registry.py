"""Registry of runnable queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoflux.plans.tables import Tables, with_ctes
from chronoflux.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = "", nullable: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``ctes`` names the shared views ``sql`` uses.

    ``nullable`` lists whole-number columns that hold nulls: both sides deliver them as
    doubles, because readers differ in how they carry null integers.
    """
    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship_package(spark)
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: out[c].cast("double") for c in nullable.split()})
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = with_ctes(ctes.split(), sql)
            if nullable:
                casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in nullable.split())
                text = f"SELECT * REPLACE ({casts}) FROM ({text})"
            ORACLE[name] = text
        return fn
    return wrap
