"""Registry of named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .derived import SQL_VIEWS, Tables

TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
SQL_TEXT: dict[str, str] = {}


@dataclass(frozen=True)
class Registered:
    build: Callable[[Tables], DataFrame]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(spark, sf_dir))


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in TABLE_QUERIES:
            raise ValueError(f"query {name} registered twice")
        TABLE_QUERIES[name] = build
        if sql is not None:
            SQL_TEXT[name] = sql
        return build

    return register


def with_views(sql: str) -> str:
    """Prefix the derived-table definitions a query refers to."""
    needed: list[str] = []

    def visit(text: str) -> None:
        named = set(re.findall(r"\w+", text))
        for name, body in SQL_VIEWS.items():
            if name not in needed and name in named:
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in needed)
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"WITH RECURSIVE {views},\n{body[len('with recursive'):]}"
    if body.lower().startswith("with"):
        return f"WITH {views},\n{body[4:]}"
    return f"WITH {views}\n{body}"
