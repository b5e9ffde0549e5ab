"""Columns that are worked out once a row, however often later ones read them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(rows: DataFrame, *names: str) -> DataFrame:
    """rows, which must not have the columns that an operator adds."""
    clash = [c for c in names if c.lower() in (x.lower() for x in rows.columns)]
    if clash:
        raise ValueError(f"rows have columns named {clash}")
    return rows


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows plus columns, which stay columns: the optimizer doesn't paste them into each expression that reads them.

    Projections of withColumns() are merged where Spark thinks it worth it, and a filter is pushed through all of them, so
    that an expression used by several others is repeated, in the plan as in the work. A generator of one row isn't
    merged. No Python function may stand in columns; it may read them. Fields of struct columns are taken before, by
    withColumns(): Spark loses those that a generator alone takes.
    """
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value) with value worked out once: inside the function of an array, Spark works out again for every element what it reads from without."""
    return F.get(F.transform(F.array(value), made), F.lit(0))
