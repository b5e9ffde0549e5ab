"""Files that the engine reads and writes: JSON caches, product catalogues, lists, saved pages, audit exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = "map<string,struct<brand:string,name:string,year:string,url:string,source:string,updated_at:bigint>>"


def identity_cache(spark: SparkSession, path: str) -> DataFrame:
    """SRC7, SRC11: a row per key of a JSON object; no rows if the file is missing or broken, entries that are no objects are left out."""
    empty = spark.createDataFrame([], "key string, brand string, name string, year string, url string, source string, updated_at bigint")
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return empty
    entries = files.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    entry = F.from_json("raw", "struct<brand:string,name:string,year:string,url:string,source:string,updated_at:bigint>")
    return entries.where(F.startswith(F.trim("raw"), F.lit("{"))).select("key", entry.alias("e")).select("key", "e.*")


def write_identity_cache(rows: DataFrame, path: str) -> None:
    """SRC8: sorted JSON lines; Spark's committer replaces the folder as a whole."""
    rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").json(path)


def upsert_identities(cache: DataFrame, new: DataFrame, least: float = 0.74) -> DataFrame:
    """SRC9: rows of enough score replace their key; a key without year is only added where it is missing.

    new has key, brand, name, year, url, source, updated_at and score; later rows win.
    """
    good = new.where(F.col("score") >= least).drop("score")
    alias = good.where("year <> ''").withColumn("key", F.concat_ws("|", F.lower("brand"), F.lower("name"), F.lit("")))
    rows = cache.withColumn("rank", F.lit(1)).unionByName(good.withColumn("rank", F.lit(0))).unionByName(alias.withColumn("rank", F.lit(2)))
    columns = [c for c in rows.columns if c != "rank"]
    best = rows.groupBy("key").agg(F.min_by(F.struct(*columns), F.struct("rank", -F.col("updated_at"), "url")).alias("e"))
    return best.select("e.*")


def products(spark: SparkSession, path: str) -> DataFrame:
    """SRC12, SRC13: products of {"products": [...]} or [...], objects only, as (handle, title, vendor, raw)."""
    files = spark.read.text(path, wholetext=True)
    whole = F.coalesce(F.get_json_object("value", "$.products"), F.col("value"))
    each = files.select(F.explode(F.from_json(whole, "array<string>")).alias("raw")).where(F.startswith(F.trim("raw"), F.lit("{")))
    field = lambda name: F.get_json_object("raw", f"$.{name}").alias(name)
    return each.select(field("handle"), field("title"), field("vendor"), "raw")


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC20: one query a line; blank lines and those that begin with # are left out."""
    rows = spark.read.text(path).select(F.trim("value").alias("query"))
    return rows.where((F.col("query") != "") & ~F.startswith("query", F.lit("#")))


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """SRC22: (path, html) of pages saved as files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def catalog_index(found: DataFrame) -> DataFrame:
    """SRC13: (key, handle, raw): the product that an address's handle ("h:...") or an identity ("i:vendor|title") leads to; of several the least handle."""
    text = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "))
    by = F.array_compact(F.array(F.when(F.col("handle") != "", F.concat(F.lit("h:"), "handle")), F.when((text("vendor") != "") & (text("title") != ""), F.concat(F.lit("i:"), text("vendor"), F.lit("|"), text("title")))))
    rows = found.select(F.explode(by).alias("key"), "handle", "raw")
    return rows.groupBy("key").agg(F.min(F.struct("handle", "raw")).alias("p")).select("key", "p.handle", "p.raw")


def write_csv(rows: DataFrame, path: str, columns: list[str], mark: bool = True) -> None:
    """SRC16: the columns in their order, with a header in each part that begins with the mark of UTF-8 (if asked for); quotes where they are needed."""
    named = [F.col(c).alias("\ufeff" + c) if mark and i == 0 else F.col(c) for i, c in enumerate(columns)]
    rows.select(*named).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_diagnostics(rows: DataFrame, folder: str, stamp: str) -> tuple[str, str]:
    """SRC19: the same rows as JSON and as CSV, in folders whose names have a time stamp; both names."""
    paths = tuple(f"{folder.rstrip('/')}/enrichment_queue_{stamp}.{kind}" for kind in ("json", "csv"))
    rows.write.mode("overwrite").json(paths[0])
    write_csv(rows, paths[1], rows.columns, mark=False)
    return paths


def snapshot_id(issues: DataFrame) -> DataFrame:
    """SRC18: one row with snapshot_id, the digest of a table (tag, row_id) whatever its order; rows meet in sums only."""
    part = lambda n: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", "tag", "row_id"), 256), n, 12), 16, 10).cast("decimal(38,0)")).cast("string")
    return issues.agg(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13)).alias("s")).select(F.substring(F.sha2("s", 256), 1, 16).alias("snapshot_id"))
