"""Queries by name with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siglake.sources import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str) -> str:
    """SQL with the views that it names before it. Its own common table expressions follow as `name AS (...), ... SELECT`, and
    `RECURSIVE` stands before them if one of them is recursive."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in views.NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for name in views.SQL:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    parts = [f"{n} AS ({views.SQL[n]})" for n in names]
    body, head = sql.strip(), "WITH "
    if body.startswith("RECURSIVE "):
        body, head = body.removeprefix("RECURSIVE "), "WITH RECURSIVE "
    own = not re.match(r"SELECT\b", body)
    if not parts:
        return head + body if own else body
    return head + ",\n".join(parts) + (",\n" if own else "\n") + body


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; without sql it is checked by tests alone."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return f

    return add
