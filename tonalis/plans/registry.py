"""Registered queries: name -> (function of session and folder, SQL that states the same result, or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonalis.session import findable
from tonalis.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Collects the queries of a module through its decorator."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function of :class:`Tables` under its own name, with its SQL if there is one."""

        def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            key = name or build.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = lambda spark, folder: build(Tables(findable(spark), folder))
            if sql:
                self.sql[key] = sql
            return build

        return add
