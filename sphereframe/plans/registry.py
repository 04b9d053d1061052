"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .views import SQL_VIEWS, Tables


@dataclass(frozen=True)
class Query:
    survey_id: str
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(tune(spark), sf_dir))

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(self.sql)


# Views other views read several times.
SHARED = {"v_grid", "v_knn", "v_edge", "v_deg", "v_lap", "v_points", "v_src", "v_dst", "v_w", "v_pool", "v_unpool", "v_cell_w", "v_cell_pool", "v_cell_unpool", "v_obs"}

QUERIES: dict[str, Query] = {}


def query(survey_id: str, sql: str | None = None, name: str | None = None):
    """Register the decorated ``Tables -> DataFrame`` function."""

    def register(build: Callable[[Tables], DataFrame]):
        key = name or build.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = Query(survey_id, key, build, sql)
        return build

    return register


def _needed(sql: str) -> list[str]:
    """Views a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for view in SQL_VIEWS:
            if view not in order and re.search(rf"\b{view}\b", text):
                visit(SQL_VIEWS[view])
                order.append(view)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Put the definitions of the views a statement uses in front of it."""
    sql = sql.strip()
    views = [f"{v} AS {'MATERIALIZED ' if v in SHARED else ''}({SQL_VIEWS[v]})" for v in _needed(sql)]
    head = "WITH "
    rest = sql
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    if match:
        head = "WITH RECURSIVE " if match.group(1) else "WITH "
        rest = ", " + sql[match.end():] if views else sql[match.end():]
    if not views and not match:
        return sql
    return head + ",\n".join(views) + "\n" + rest
