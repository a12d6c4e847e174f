"""Registry of named queries and their SQL counterparts.

A query returns a DataFrame for (spark, sf_dir).  Floating columns are cut to
six decimals on both sides, because a distributed sum has no fixed order.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cyclespark.plans import fixture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _six_decimals(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            (F.floor(F.col(f"`{f.name}`") * 1e6 + 0.5) / 1e6).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, doubles: str = "", base: str = "records"):
    """Register a query; ``sql`` is the body that follows the shared CTEs.

    ``doubles`` names the floating columns of the SQL result and ``base`` the
    shared CTEs it needs (records, raw, cells; comma separated, may be empty).
    """

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: _six_decimals(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(sql, doubles, base)
        return fn

    return register


_BASES = {"records": fixture.records_sql, "raw": fixture.raw_sql, "cells": fixture.cells_sql}


def oracle(sql: str, doubles: str, base: str) -> str:
    ctes = [_BASES[b.strip()]() for b in base.split(",") if b.strip()]
    body = sql.strip()
    if body.startswith("WITH "):
        body = body[5:]
        text = "WITH RECURSIVE " + ", ".join([*ctes, body])
    else:
        text = ("WITH " + ", ".join(ctes) + " " if ctes else "") + body
    # Tables read by several branches are computed once.
    text = re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", text)
    names = doubles.split()
    if not names:
        return text
    swaps = ", ".join(f"floor({n} * 1e6 + 5e-1) / 1e6 AS {n}" for n in names)
    return f"SELECT * REPLACE ({swaps}) FROM ({text})"
