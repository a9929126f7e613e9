"""Registry of named queries: a DataFrame plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from standlab.session import prepare
from standlab.sources.fixtures import Inputs, with_views


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    plan: Callable[[Inputs], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.plan(Inputs(prepare(spark), sf_dir))


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, views: str = "", sql: str | None = None):
    """Register a plan under a name with the inventory items it covers."""
    def register(plan):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        text = None if sql is None else (with_views(views, sql) if views else sql.strip())
        REGISTRY[name] = Query(name, tuple(ids.split()), plan, text)
        return plan
    return register
