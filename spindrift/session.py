"""Sessions and workspaces: a folder of Parquet tables, one view for each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a file of a settled table.
FILE_ROWS = 100_000

def session(master: str | None = None, **settings: str) -> SparkSession:
    """UTC, ANSI and adaptive execution on; a master and further settings where given."""
    builder = SparkSession.builder.appName("spindrift")
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir. Only a local master, as in tests, may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir is unset and {master} has no folder that all executors share")
    return "/tmp/checkpoints"


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: made once for plans that read it often, with its statistics, and safe from
    lost executors. Files stay until the cluster's cleaner takes them."""
    return settled_parts([df], name)


def settled_parts(parts: list[DataFrame], name: str = "table") -> DataFrame:
    """The union of parts of the same columns, settled one after another: shuffle files go when their part is written, so
    the disk holds those of one part at a time. Files are of few rows, so that a task that reads some of them,
    up to Spark's bytes a task, reads a bounded number of rows however well they compress."""
    spark = parts[0].sparkSession
    path = f"{shared_folder(spark)}/spindrift/{name}-{uuid.uuid4().hex}"
    if spark.conf.get(RELEASE) != "true":
        spark.conf.set(RELEASE, "true")
    for part in parts:
        part.select(*parts[0].columns).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


class Workspace:
    """Tables of one project under a folder; switching workspaces is opening another folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def register(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(name)
