"""Registry of runnable queries and their check SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.views import SEGMENTS_SQL, VIEWS, WORDS_SQL, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _view_sql(name: str) -> str:
    if name == "segments":
        return SEGMENTS_SQL
    if name == "words":
        return WORDS_SQL
    spec = VIEWS[name]
    cols = ", ".join(f'{e} AS "{n}"' for n, e in spec.columns.items())
    return f"SELECT {cols} FROM {spec.source} WHERE {spec.where}".replace("EPOCH_US", "epoch_us")


def with_views(sql: str) -> str:
    """Prefix the check SQL with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in (*VIEWS, "segments", "words"):
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.I):
                visit(_view_sql(name))
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({_view_sql(n)})" for n in needed]
    body = sql.strip()
    own = re.match(r"WITH(\s+RECURSIVE)?\b", body, re.I)
    if own:
        ctes.append(body[own.end():].strip())
        return "WITH RECURSIVE " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a query; ``sql`` is the DuckDB check over the same tables.

    ``doubles`` names check columns that DuckDB types as decimals because of
    decimal literals; they are compared as doubles.
    """

    def wrap(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            check = with_views(sql)
            if doubles:
                casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in doubles)
                check = f"SELECT * REPLACE ({casts}) FROM ({check})"
            ORACLES[name] = check
        return fn

    return wrap
