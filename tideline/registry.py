"""Registry of named queries with their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tideline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    fns: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                ship(spark)
                return fn(spark, sf_dir)

            run.__name__, run.__doc__ = name, fn.__doc__
            self.fns[name] = run
            if sql:
                self.sql[name] = sql
            return fn

        return add
