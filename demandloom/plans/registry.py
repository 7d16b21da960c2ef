"""Registry of named queries with optional SQL twins over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandloom.plans.views import VIEWS

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under `name`; `sql` may read the shared views by name."""

    def register(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"query {name} registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _SQL[name] = with_views(sql)
        return build

    return register


def with_views(sql: str) -> str:
    """Prepend the shared views the statement reads, directly or through one another, as common table expressions."""
    needed: list[str] = []
    text = sql
    for view in reversed(VIEWS):
        if re.search(rf"\b{view}\b", text):
            needed.insert(0, view)
            text += VIEWS[view]
    body = sql.strip()
    if not needed:
        return body
    ctes = ",\n".join(f"{view} AS MATERIALIZED (\n{VIEWS[view].strip()}\n)" for view in needed)
    rest = re.sub(r"^WITH\s+", "", body, flags=re.IGNORECASE)
    return f"WITH {ctes}" + (f",\n{rest}" if rest != body else f"\n{body}")


def registered() -> dict[str, Builder]:
    return dict(_BUILDERS)


def registered_sql() -> dict[str, str]:
    return dict(_SQL)
