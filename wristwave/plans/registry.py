"""Name -> query and name -> oracle SQL."""

from __future__ import annotations

import functools
from typing import Callable

from wristwave.session import ship
from wristwave.sources.tables import sql

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(spark, sf_dir) -> DataFrame`` with an optional DuckDB twin."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark, sf):
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = sql(oracle, *uses)
        return fn

    return wrap


# Rounding for value comparison. The boundary sits off the decimal grid (0.5137 instead of
# 0.5) so that exact decimal ties cannot fall to different sides in two engines.
def r(c, digits: int = 4):
    from pyspark.sql import functions as F

    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c.cast("double") * (10**digits) + 0.5137) / F.lit(float(10**digits))


def rq(text: str, digits: int = 4) -> str:
    return f"floor(({text})::DOUBLE * {10**digits} + 0.5137::DOUBLE) / {float(10**digits)}::DOUBLE"
