"""Registry of named queries: a Spark job and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from callweave.plans.views import VIEWS, duck_with
from callweave.plans.workspace import Workspace

SECTIONS = ["relational", "aggregates", "windows", "merges", "text_jobs", "vectors", "graphs",
            "model_jobs", "feedback", "sources", "streams"]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Workspace], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(views: str = "", sql: str | None = None):
    """Register a query.  ``sql`` is a select, or further CTEs and a select."""

    def register(fn):
        text = None
        if sql is not None:
            names = [v for v in views.split() if v in VIEWS]
            body = sql.strip()
            if names:
                joint = "\n" if body.lower().startswith("select") else ",\n"
                text = f"with recursive {duck_with(names)}{joint}{body}"
            else:
                text = body if body.lower().startswith("select") else f"with recursive {body}"
        QUERIES[fn.__name__] = Query(fn.__name__, fn, text)
        return fn

    return register


def load() -> dict[str, Query]:
    for section in SECTIONS:
        import_module(f"callweave.plans.{section}")
    return QUERIES


def runner(item: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return item.run(Workspace(spark, folder))

    run.__name__ = item.name
    return run
