"""Helpers that several of the operators share."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.sources.tables import settled, shared_root, table  # noqa: F401
from kelpline.sources.tables import forget as _delete

#: Most rows of a side that is broadcast after its size was checked; larger sides are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Slices of a key that may hold a third of all rows.
SALTS = 64
#: A key is hot where it has this share of the rows or more, so there are no more hot keys than its inverse.
HOT = 1 / 200


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_root(spark)}/kelpline-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df kept by the executors while it is read again: for small tables between two settled() ones.

    What a lost executor held is made anew from the last settled table; forget() ends it. Held tables shouldn't be
    built on each other in long rows: the plans of all of them stay in the driver.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def forget(df: DataFrame) -> None:
    """Ends a held() table, or deletes the files of a settled() one, that no later result reads."""
    if df.storageLevel.useDisk or df.storageLevel.useMemory:
        df.unpersist()
    else:
        _delete(df)


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of data in the shared folder; name should say what it holds (by a digest), as one that is there is not written again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/kelpline-files/{name}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{uuid.uuid4().hex}")
        out = files.create(part)
        out.write(data)
        out.close()
        if not files.rename(part, path) and not files.exists(path):
            raise OSError(f"cannot write {path.toString()}")
    return files.makeQualified(path).toString()


def by_batches(rows: DataFrame, function: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """rows.mapInPandas(function, schema), with the long columns `ids` as text on their way through Python.

    pandas would make doubles of longs beside a null, and those above 2^53 would become other ids.
    """
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    out = rows.withColumns({c: F.col(c).cast("long").cast("string") for c in ids if c in rows.columns})
    made = out.mapInPandas(function, ", ".join(f"{n} {'string' if n in ids else t}" for n, t in fields))
    return made.select(*[F.col(n).cast("long").alias(n) if n in ids else n for n, _ in fields])


def give_back() -> None:
    """Returns to the system what earlier tasks of this Python worker have freed and the C library kept; does nothing elsewhere than on glibc."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """What is run in here sends Python at most so many rows at a time: for rows that may each be large. The session's own number is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key, "10000"))
    spark.conf.set(key, str(rows if before <= 0 else min(before, rows)))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


def salted_group_min(rows: DataFrame, keys: list[str], value: str, out: str, unique: str | None = None, salts: int = SALTS) -> DataFrame:
    """rows plus out, the smallest value of its group, without a hot group meeting in one task.

    Groups are cut into slices by a hash of unique (value if not given); each slice has one row in the join
    that follows, so a hot key costs at most `salts` rows a group there, and rows meet their slice, never
    their whole group.
    """
    cut = rows.withColumn("__salt", F.pmod(F.xxhash64(unique or value), F.lit(salts)).cast("int"))
    slices = cut.groupBy(*keys, "__salt").agg(F.min(value).alias("__low"))
    lows = slices.groupBy(*keys).agg(F.min("__low").alias(out))
    known = slices.select(*keys, "__salt").join(lows, keys)
    return cut.join(known, [*keys, "__salt"]).drop("__salt")


def join_small(rows: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Joins a row or a few per key onto rows: by broadcast if small was counted to be small, else salted."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), keys, how)
    cut = rows.withColumn("__salt", F.floor(F.rand(7) * salts).cast("int"))
    wide = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cut.join(wide, [*keys, "__salt"], how).drop("__salt")


def hot_keys(counts: DataFrame, key: str, side: str | None = None) -> tuple[dict, dict]:
    """The hot keys and the rows of each side, of counts (key, k, and side if there are several): {side: keys}, {side: rows}.

    One job where no key is hot; the keys are 1 / HOT a side at most.
    """
    by = [] if side is None else [side]
    sums = counts.groupBy(*by).agg(F.sum("k").alias("n"), F.max("k").alias("most")).collect()  # one row a side
    total = {r[side] if side else None: r["n"] or 0 for r in sums}
    found = {}
    for r in sums:
        own = r[side] if side else None
        if r["n"] and r["most"] >= SALTS and r["most"] >= HOT * r["n"]:
            mine = counts if side is None else counts.where(F.col(side) == own)
            found[own] = [x[key] for x in mine.where((F.col("k") >= HOT * r["n"]) & (F.col("k") >= SALTS)).select(key).collect()]
    return found, total


def join_hot(rows: DataFrame, side: DataFrame, key: str, how: str = "inner", hot: list | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """rows joined with side, which has one row a key (or a few) where rows may have a third of all: hot keys of rows are met by broadcast.

    hot are the hot keys if they are known already, else they are counted: at most 1 / HOT of them, whatever the table, so
    what is broadcast is bounded. rows and side should be settled, as both are read twice.
    """
    found = hot_keys(rows.groupBy(key).agg(F.count("*").alias("k")), key)[0].get(None, []) if hot is None else hot
    if not found:
        return rows.join(side, [key, *extra], how)
    few = F.col(key).isin(found)
    return rows.where(few).join(F.broadcast(side.where(few)), [key, *extra], how).unionByName(rows.where(~few).join(side.where(~few), [key, *extra], how))


def ranked(rows: DataFrame, order: list, out: str) -> DataFrame:
    """rows plus out, their number from 1 in the order given, without all of them in one task.

    Rows are dealt into ranges of the order, sorted there and written with their place in their range; a range's rows
    then go on from the count of the ranges before it (one row a range). order should tell equal rows apart,
    else a large set of them is one range. The result is read from a settled() table.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settled(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    range_of, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    sizes = placed.groupBy(range_of.alias("__range")).agg(F.count("*").alias("__k"))
    before = F.coalesce(F.sum("__k").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__before"))  # one row a range
    return placed.withColumn("__range", range_of).join(F.broadcast(starts), "__range").withColumn(out, F.col("__before") + place + 1).drop("__range", "__at", "__before")
