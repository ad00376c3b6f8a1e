"""Query registry: name -> (Spark function, SQL text)."""

from __future__ import annotations

from collections.abc import Callable

from .views import with_views

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str, sql: str):
    """Register ``fn(tables)`` with SQL written on top of the named views."""

    def add(fn):
        from .tables import Tables

        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ORACLES[name] = with_views(views.split(), sql)
        return fn

    return add


def also(name: str, like: str):
    """Register ``fn(tables)`` under another name with the SQL of an earlier query."""

    def add(fn):
        from .tables import Tables

        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        ORACLES[name] = ORACLES[like]
        return fn

    return add
