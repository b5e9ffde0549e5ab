"""Several tables that a batch changes together: written aside, then published by one entry of a ledger."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """MG12: tables in a shared folder that batches write together, whole or not at all, and once however often they run.

    A batch's tables are written below their own names in its own folders, overwriting what an earlier try left there; nothing
    reads those until the ledger has an entry for the batch, which is renamed into place. So a batch that fails between two tables
    has changed nothing, and one that is run again after its entry changes nothing more.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self.path(f"{self.root}/_ledger"))

    def batches(self) -> list[int]:
        """Numbers of the published batches, in order."""
        names = [f.getPath().getName() for f in self.files.listStatus(self.path(f"{self.root}/_ledger"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def commit(self, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Writes and publishes a batch; false if it was published before."""
        entry = self.path(f"{self.root}/_ledger/{batch:012d}.json")
        if self.files.exists(entry):
            return False
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/{batch:012d}")
        part = self.path(f"{self.root}/_ledger/.{batch:012d}.part")
        out = self.files.create(part, True)
        out.write(json.dumps(sorted(tables)).encode())
        out.close()
        if not self.files.rename(part, entry) and not self.files.exists(entry):
            raise OSError(f"cannot publish batch {batch} in {self.root}")
        return True

    def rows(self, name: str, schema: str) -> DataFrame:
        """All published rows of a table, with the number of their batch."""
        folders = [(b, f"{self.root}/{name}/{b:012d}") for b in self.batches()]
        folders = [f for b, f in folders if self.files.exists(self.path(f))]
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        read = self.spark.read.schema(schema).parquet(*folders)
        return read.withColumn("batch", F.regexp_extract(F.input_file_name(), rf"/{name}/(\d+)/[^/]*$", 1).cast("long"))

    def latest(self, name: str, schema: str, key: str) -> DataFrame:
        """The published row of each key of its last batch; partial maxima before the shuffle."""
        rows = self.rows(name, schema)
        columns = [c for c in rows.columns if c != "batch"]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
        return newest.select("r.*")


DETAILS = "canonical_fg_url string, name string, house string, year int, cards string, quality_status string"
RECORDS = "record_key string, name string, house string, year int, canonical_fg_url string"
JOBS = "job_id string, status string, completed_at timestamp"


def completions(ledger: Ledger):
    """A foreachBatch function: a batch of completed jobs (job_id, completed_at, payload fields) becomes details, records and job states together.

    Of several rows of one address, record or job the latest counts; rows without an address or cards complete nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = batch.where("canonical_fg_url <> '' and cards <> '' and job_id is not null")

        def newest(schema: str, key: str) -> DataFrame:
            columns = [c.split()[0] for c in schema.split(", ")]
            return good.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("completed_at", "job_id")).alias("r")).select("r.*")

        good = good.withColumns({"status": F.lit("completed"), "quality_status": F.coalesce("quality_status", F.lit("complete")), "record_key": F.concat(F.lit("fg:"), "canonical_fg_url")})
        ledger.commit(number, {"details": newest(DETAILS, "canonical_fg_url"), "records": newest(RECORDS, "record_key"), "jobs": newest(JOBS, "job_id")})

    return write
