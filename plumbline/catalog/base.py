"""Registry of named queries: a Spark plan over the tables and, where SQL can say the
same, the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import fixed
from plumbline.plans.dataset import Dataset


@dataclass(frozen=True)
class Query:
    name: str
    plan: Callable[[Dataset], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; its docstring says what it answers."""

    def register(plan: Callable[[Dataset], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, plan, sql)
        return plan

    return register


def big(column: Column | str) -> Column:
    """Counts, ranks and sizes leave a query as BIGINT."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("bigint")


def six(column: Column | str) -> Column:
    """Doubles leave a query as six-decimal text, the form every engine agrees on."""
    return fixed(F.col(column) if isinstance(column, str) else column)


def joined(column: Column | str, separator: str = "|") -> Column:
    """Arrays leave a query as joined text."""
    return F.array_join(F.col(column) if isinstance(column, str) else column, separator)
