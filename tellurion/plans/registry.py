"""Every registered query with its DuckDB counterpart, where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations", "pages")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return keep


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that a statement names."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def sql_query(name: str, sql: str, oracle: str | None = None) -> None:
    """A query that is SQL in both engines; oracle differs only where a spelling does."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, sql)
        return spark.sql(sql)

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


from tellurion.plans import engine_queries, ingest_queries, sql_surface, telemetry  # noqa: E402, F401
