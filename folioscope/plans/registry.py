"""Named queries, each a Spark plan and, where SQL can say the same, its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """SQL for a model table, named `v_...`, that queries may read."""
    VIEWS[name] = sql.strip()


def _needed(sql: str) -> list[str]:
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in set(re.findall(r"\bv_\w+", text)) & VIEWS.keys() - wanted:
            wanted.add(name)
            todo.append(VIEWS[name])
    return [n for n in VIEWS if n in wanted]


def compose(sql: str) -> str:
    """`sql` with the views it reads put in front as common table expressions."""
    sql = sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(sql))
    if not views:
        return sql
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.IGNORECASE)
    if not m:
        return f"WITH {views}\n{sql}"
    return f"WITH {m.group(1) or ''}{views},\n{sql[m.end():]}"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = compose(sql)
        return fn
    return add
