"""One issue and what belongs to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.search import top


def get_issue(issues: DataFrame, comments: DataFrame, changelogs: DataFrame, key: str) -> dict[str, DataFrame]:
    """The issue, all comments in order, and its 20 latest changes."""
    mine = lambda df: df.filter(F.col("issue_key") == key.upper())
    return {"issue": mine(issues), "comments": mine(comments).orderBy(F.col("created").asc_nulls_last(), "comment_id"),
            "changes": top(mine(changelogs), "changed_at", 20, "field", "to_value")}


def latest(rows: DataFrame, key: str, value, at: str, limit: int = 20, *ties: str) -> DataFrame:
    """The latest rows of one key."""
    return top(rows.filter(F.col(key) == value), at, limit, *ties)


def issue_commits(commits: DataFrame, refs: DataFrame, files: DataFrame, key: str, repo_path: str | None = None) -> DataFrame:
    """Commits that name an issue, latest first, each with its files."""
    chosen = commits.join(refs.filter(F.col("issue_key") == key.upper()), commits["hash"] == refs["commit_hash"], "left_semi")
    if repo_path:
        chosen = chosen.filter(F.col("repo_path").ilike(f"%{repo_path}%"))
    listed = files.groupBy("commit_hash").agg(
        F.array_sort(F.collect_list(F.struct("file_path", "status", "additions", "deletions"))).alias("files"))
    out = chosen.join(listed, chosen["hash"] == listed["commit_hash"], "left").drop("commit_hash")
    return out.orderBy(F.col("committed_at").desc_nulls_last(), "hash")


def issue_prs(prs: DataFrame, refs: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Pull requests that name an issue, latest first, each with its own reviews in order."""
    pr = ["repo_full_name", "pr_number"]
    chosen = prs.withColumnRenamed("number", "pr_number").join(refs.filter(F.col("issue_key") == key.upper()), pr, "left_semi")
    listed = reviews.groupBy(*pr).agg(F.array_sort(F.collect_list(F.struct("submitted_at", "reviewer", "state"))).alias("reviews"))
    return chosen.join(listed, pr, "left").orderBy(F.col("created_at").desc_nulls_last(), *pr)


#: Kinds of events in the order they take within one moment.
KINDS = ("created", "changed", "commit", "pr_opened", "pr_reviewed", "pr_merged")


def timeline(parts: dict[str, DataFrame]) -> DataFrame:
    """One stream of events from parts by kind, each with (issue_key, at, detail); events without a time are left out."""
    out = None
    for order, kind in enumerate(KINDS):
        if kind in parts:
            rows = parts[kind].select("issue_key", F.col("at").cast("timestamp_ntz").alias("at"), F.lit(kind).alias("kind"),
                                      F.lit(order).alias("kind_order"), F.col("detail").cast("string").alias("detail"))
            out = rows if out is None else out.unionByName(rows)
    return out.filter("at is not null")


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy("issue_key", "at", "kind_order", "detail")
