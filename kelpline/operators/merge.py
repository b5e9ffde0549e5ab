"""Upserts and merges as joins and aggregates; a rewritten table replaces an update in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, guard: str | None = None) -> DataFrame:
    """MG3 to MG5, MG16: new values where they aren't null, else the old ones.

    With a guard column, an old row whose guard is set and differs from the new one's stays as it is.
    """
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    agree = F.lit(True)
    if guard:
        a, b = F.col(f"o.{guard}"), F.col(f"n.{guard}")
        agree = a.isNull() | b.isNull() | (a == b)
    merged = [F.when(agree, F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(F.coalesce(F.col(f"o.{key}"), F.col(f"n.{key}")).alias(key), *merged)


def fill_only(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """J14, MG16, MG23: only nulls are filled."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "left").select(F.col(f"o.{key}"), *[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in columns])


def merge_group(rows: DataFrame, keys: list[str], first: dict[str, str], least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """MG1: duplicates to one row: the first value that isn't null by an order column, the least, the greatest."""
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c, order in first.items()]
    return rows.groupBy(*keys).agg(*firsts, *[F.min(c).alias(f"first_{c}") for c in least], *[F.max(c).alias(f"last_{c}") for c in greatest])


def trust_coalesce(sources: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Sources in order of trust; each field is the first that isn't null. One shuffle of their union, partly aggregated."""
    rows = sources[0].select(key, *columns, F.lit(0).alias("trust"))
    for i, more in enumerate(sources[1:], 1):
        rows = rows.unionByName(more.select(key, *columns, F.lit(i).alias("trust")))
    picked = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("trust"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*picked)


def merge_maps(live: Column, other: Column, right_wins: bool = False) -> Column:
    """SC10, SC11: two maps as one; on a shared key live stays, unless right_wins."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(live, empty), F.coalesce(other, empty), lambda k, a, b: F.coalesce(b, a) if right_wins else F.coalesce(a, b))


def claim_once(claims: DataFrame, known: DataFrame, key: str, order: str) -> DataFrame:
    """MG15, ST7: the first claim of each key that wasn't known before."""
    fresh = claims.join(known.select(key), key, "left_anti")
    return fresh.groupBy(key).agg(F.min_by(F.struct(*claims.columns), order).alias("e")).select("e.*")
