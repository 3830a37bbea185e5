"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, sql: str | None = None, doubles: tuple[str, ...] = ()):
        """Register a function of a table reader: t('orders') is that table. `doubles` are columns that the SQL gives as decimals."""
        if sql and doubles:
            sql = f"select * replace ({', '.join(f'cast({c} as double) as {c}' for c in doubles)}) from ({sql})"

        def put(f: Callable[..., DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

            run.__name__, run.__doc__ = f.__name__, f.__doc__
            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return put
