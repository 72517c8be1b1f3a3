"""A book of queries: a name, a Spark query and, where SQL can state it, the SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.plans.measures import MEASURES
from pairscope.sources.adapters import adapter, twin
from pairscope.session import table


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, adapters: str, plan: Callable[..., DataFrame], sql: str | None = None, tables: str = "", views: str = "") -> None:
        """plan gets the named adapters, then the named driver tables; views are what the SQL reads besides."""

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [adapter(spark, sf_dir, n) for n in adapters.split()] + [table(spark, sf_dir, n) for n in tables.split()]
            out = plan(*frames)
            return out.select(*(F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) if c in doubles else F.col(f"`{c}`") for c in out.columns))

        doubles = MEASURES.get(name, [])
        self.queries[name] = query
        if sql:
            body = twin(f"{adapters} {views}", sql)
            rounded = ", ".join(f'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"' for c in doubles)
            self.oracles[name] = f"SELECT * REPLACE ({rounded}) FROM ({body}) rounded" if doubles else body
