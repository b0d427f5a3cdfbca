"""Incremental ingest: files that land in a folder are upserted into a bucketed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.operators.commits import Conflict
from spindrift.operators.tables import BucketedTable
from spindrift.session import settled
from spindrift.sources import git_log
from spindrift.sources.appended import SPLIT_BYTES, AppendedRecords
from spindrift.sources.dumps import commit_refs

#: Times that a batch is merged again after another writer came first.
TRIES = 5


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of a table's snapshots, oldest first."""
    from spindrift.operators import commits

    return list(commits.all_of(spark, folder))


def current(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    return BucketedTable(spark, folder, schema, []).read()


def patiently(merge: Callable[[], int], tries: int = TRIES) -> int:
    """merge() until no other writer comes first; it begins from the last snapshot each time."""
    for left in range(tries, 0, -1):
        try:
            return merge()
        except Conflict:
            if left == 1:
                raise
    raise ValueError("no tries")


def ingest(spark: SparkSession, landing: str, table: str, schema: StructType, keys: list[str], order: str, checkpoint: str) -> None:
    """Upsert all that has landed since the last call, and stop.

    A batch rewrites the buckets of its keys only. One that is tried again writes the same rows, so reading
    a minute twice around a high-water mark does no harm.
    """
    def merge(batch: DataFrame, number: int) -> None:
        patiently(lambda: BucketedTable(batch.sparkSession, table, schema, keys).merge(batch, order))

    stream = spark.readStream.schema(schema).parquet(landing)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


#: Tables that a followed git log keeps, by what, and their schemas. Children lie in their commit's bucket.
LOG_TABLES = {
    "commits": (["hash"], "hash string, message string, author string, email string, committed_at timestamp, parents array<string>, repo_path string"),
    "commit_files": (["commit_hash"], "commit_hash string, file_path string, status string, additions int, deletions int"),
    "commit_issue_refs": (["commit_hash"], "commit_hash string, issue_key string"),
}


def log_table(spark: SparkSession, folder: str, name: str) -> BucketedTable:
    keys, schema = LOG_TABLES[name]
    return BucketedTable(spark, f"{folder}/{name}", StructType.fromDDL(schema), keys)


def save_commits(spark: SparkSession, folder: str, log: DataFrame) -> None:
    """Upsert the commits of a log, and put its files and references in the place of those its commits had."""
    commits = git_log.commits(log).dropDuplicates(["hash"])
    once = settled(log.dropDuplicates(["hash"]), "log")
    parents = once.select(F.col("hash").alias("commit_hash"))
    patiently(lambda: log_table(spark, folder, "commits").merge(commits))
    children = {"commit_files": git_log.commit_files(once), "commit_issue_refs": commit_refs(git_log.commits(once)).distinct()}
    for name, rows in children.items():
        patiently(lambda: log_table(spark, folder, name).replace(parents, ["commit_hash"], rows))  # noqa: B023


def follow_log(spark: SparkSession, path: str, folder: str, repo_path: str, checkpoint: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Save all commits that were appended to a log since the last call, and stop."""
    spark.dataSource.register(AppendedRecords)
    records = (spark.readStream.format("appended_records").option("path", path).option("separator", "\x1e").option("begins", "true")
               .option("split_bytes", split_bytes).load())
    save = lambda batch, number: save_commits(batch.sparkSession, folder, git_log.parsed(batch, repo_path))
    records.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
