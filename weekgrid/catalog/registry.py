"""Registry of queries over the driver's tables, each with its SQL equivalent where one exists."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.standins import Standins
from .prelude import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Prefix ``body`` with the shared views it names, directly or through other views."""
    names = list(VIEWS)
    wanted: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"[a-z_0-9]+", pending.pop()))
        for name in names:
            if name in words and name not in wanted:
                wanted.add(name)
                pending.append(VIEWS[name])
    if not wanted:
        return body
    parts = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names if n in wanted)
    return f"WITH {parts}\n{body.strip()}"


def query(name: str, sql: str | None = None):
    """Register ``fn(tables: Standins) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Standins], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Standins(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register
