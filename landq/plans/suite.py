"""Named queries: each has a Spark plan over `Views` and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from landq.sources.views import Views, with_views


class Suite:
    def __init__(self) -> None:
        self.plans: dict[str, Callable[[Views], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None, *views: str) -> Callable:
        """Register the decorated function; `sql` may use the named views."""
        def register(plan: Callable[[Views], DataFrame]) -> Callable:
            self.plans[name] = plan
            if sql is not None:
                self.sql[name] = with_views(sql, *views)
            return plan
        return register

    def callables(self) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
        def bind(plan: Callable[[Views], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            return lambda spark, folder: plan(Views(spark, folder))
        return {name: bind(plan) for name, plan in self.plans.items()}
