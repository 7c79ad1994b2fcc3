"""Named queries and, where SQL can say the same, their check query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bindings import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named subquery for check queries; later ones may use earlier ones."""
    VIEWS[name] = sql


def with_views(sql: str) -> str:
    """Prefix the views a check query refers to, directly or not."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(VIEWS[name])
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in VIEWS if n in needed)
    own = re.match(r"\s*WITH(\s+RECURSIVE)?\b", sql)
    if own:
        return f"WITH{own.group(1) or ''} {views},\n{sql[own.end():]}"
    return f"WITH {views}\n{sql}"


def query(key: str, sql: str | None = None):
    """Register a plan over :class:`Tables` under ``key``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round result columns and drop the sign of zero, so that two engines agree on the last bit."""
    scale = 10.0**digits
    return df.withColumns({n: F.rint(F.col(n) * scale) / scale + 0.0 for n in names})


def r(expr: str, name: str, digits: int = 6) -> str:
    """The SQL for :func:`rounded`."""
    return f"round_even(({expr}) * 1e{digits}, 0) / 1e{digits} + 0e0 AS {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n, n) for n in names)
