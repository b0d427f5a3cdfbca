"""Commits and their files from the text of a git log.

The log is written by

    git log --first-parent --raw --numstat --abbrev=40 --format=%x1e%H%x1f%an%x1f%ae%x1f%cI%x1f%B%x1f

Commits are cut at the byte 1E, so that Spark splits a long log between tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.sources.dumps import file_status

FIELDS = ("hash", "author", "email", "committed_at", "message", "changes")


def read(spark: SparkSession, path: str, repo_path: str, since: str | None = None) -> DataFrame:
    """One row a commit, with its changes as text; since leaves out older commits. Parents are not kept."""
    return parsed(spark.read.text(path, lineSep="\x1e"), repo_path, since)


def parsed(records: DataFrame, repo_path: str, since: str | None = None) -> DataFrame:
    """The commits of log records (value)."""
    parts = F.split("value", "\x1f", 6)
    rows = records.filter(F.size(parts) == len(FIELDS))
    rows = rows.select(*(parts[i].alias(n) for i, n in enumerate(FIELDS)))
    rows = rows.withColumns({"committed_at": F.col("committed_at").try_cast("timestamp"), "message": F.rtrim(F.col("message"), F.lit("\n")),
                             "repo_path": F.lit(repo_path), "parents": F.array().cast("array<string>")})
    return rows if since is None else rows.filter(F.col("committed_at") >= F.lit(since).cast("timestamp"))


def commits(log: DataFrame) -> DataFrame:
    return log.select("hash", "message", "author", "email", "committed_at", "parents", "repo_path")


def commit_files(log: DataFrame) -> DataFrame:
    """One row a file. Line n of the numbers belongs to line n of the states; binary files count 0 lines.

    A deleted file has its old path, a renamed one its new path.
    """
    lines = F.split("changes", "\n")
    states = F.filter(lines, lambda x: x.startswith(":"))
    numbers = F.filter(lines, lambda x: x.rlike("^(\\d+|-)\t"))
    change = log.select("hash", F.explode(F.arrays_zip(states.alias("state"), numbers.alias("number"))).alias("x"))
    state, number = F.split("x.state", "\t"), F.split("x.number", "\t")
    count = lambda i, n: F.coalesce(number[i].try_cast("int"), F.lit(0)).alias(n)
    kind = F.substring(F.element_at(F.split(state[0], " "), -1), 1, 1)
    return change.filter("x.state is not null").select(
        F.col("hash").alias("commit_hash"), F.element_at(state, -1).alias("file_path"), file_status(kind).alias("status"), count(0, "additions"), count(1, "deletions"))
