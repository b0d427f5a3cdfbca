"""Filtered, ordered and limited lookups, with full-text search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.stemming import stemmed_hits
from spindrift.functions.text import has, matches


def top(df: DataFrame, by: str, limit: int, *ties: str) -> DataFrame:
    """The latest rows, nulls last; ties settle the order of equal ones."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(limit)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_match(rows: DataFrame, keys: list[str], text: Column, query: str, stemmed: bool) -> DataFrame:
    """rows with _full: whether the text has all terms of the query, as they stand or by their stems."""
    if not stemmed:
        return rows.withColumn("_full", matches(text, query))
    hits = stemmed_hits(rows, keys, text, query).select(*(F.col(k).alias(f"_{k}") for k in keys), F.lit(True).alias("_hit"))
    same = [rows[k].eqNullSafe(hits[f"_{k}"]) for k in keys]
    return rows.join(hits, same, "left").withColumn("_full", F.coalesce("_hit", F.lit(False))).drop("_hit", *(f"_{k}" for k in keys))


def matching(rows: DataFrame, keys: list[str], text: Column, query: str, stemmed: bool) -> DataFrame:
    return with_match(rows, keys, text, query, stemmed).filter("_full").drop("_full")


def query_issues(issues: DataFrame, search: str | None = None, project: str | None = None, status: str | None = None,
                 assignee: str | None = None, issue_type: str | None = None, limit: int = 50, stemmed: bool = False) -> DataFrame:
    """Issues by filters; where full-text search finds none, by a substring of summary or description.

    Full matches are ranked before others, so that the first rows tell whether there are any.
    """
    where = []
    if project:
        where.append(F.col("project_key") == project.upper())
    if status:
        where.append(F.col("status").ilike(status))
    if issue_type:
        where.append(F.col("issue_type").ilike(issue_type))
    if assignee:
        where.append(has("assignee", assignee))
    columns = ["issue_key", "project_key", "summary", "issue_type", "status", "assignee", "updated"]
    rows = issues.filter(_all(where))
    if search:
        text = F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce("description", F.lit("")))
        rows = with_match(rows, ["issue_key"], text, search, stemmed)
        rows = rows.filter(F.col("_full") | has("summary", search) | has("description", search))
        best = rows.orderBy(F.desc("_full"), F.col("updated").desc_nulls_last(), "issue_key").limit(limit)
        rows = best.withColumn("_any", F.max("_full").over(Window.partitionBy(F.lit(1)))).filter("_full = _any")
    return top(rows, "updated", limit, "issue_key").select(*columns)


def query_commits(commits: DataFrame, files: DataFrame | None = None, search: str | None = None, author: str | None = None,
                  since: str | None = None, until: str | None = None, file_path: str | None = None,
                  repo_path: str | None = None, limit: int = 50, stemmed: bool = False) -> DataFrame:
    """Commits by filters; a file filter keeps those with such a file."""
    where = []
    if author:
        where.append(has("author", author))
    if repo_path:
        where.append(has("repo_path", repo_path))
    if since:
        where.append(F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    if until:
        where.append(F.col("committed_at") <= F.lit(until).cast("timestamp_ntz"))
    rows = commits.filter(_all(where))
    if search:
        rows = matching(rows, ["hash"], F.concat_ws(" ", "message", "author"), search, stemmed)
    if file_path:
        rows = rows.join(files.filter(has("file_path", file_path)), rows["hash"] == files["commit_hash"], "left_semi")
    return top(rows, "committed_at", limit, "hash")


def query_prs(prs: DataFrame, search: str | None = None, state: str | None = None, author: str | None = None,
              base_ref: str | None = None, since: str | None = None, limit: int = 50, stemmed: bool = False) -> DataFrame:
    where = []
    if state:
        where.append(F.col("state") == state.lower())
    if author:
        where.append(has("author", author))
    if base_ref:
        where.append(F.col("base_ref") == base_ref)
    if since:
        where.append(F.col("updated_at") >= F.lit(since).cast("timestamp_ntz"))
    rows = prs.filter(_all(where))
    if search:
        rows = matching(rows, ["repo_full_name", "number"], F.concat_ws(" ", "title", "body"), search, stemmed)
    return top(rows, "updated_at", limit, "repo_full_name", "number")


def query_releases(releases: DataFrame, search: str | None = None, limit: int = 20, stemmed: bool = False) -> DataFrame:
    text = F.concat_ws(" ", "name", "body", "tag_name")
    rows = matching(releases, ["repo_full_name", "tag_name"], text, search, stemmed) if search else releases
    return top(rows, "published_at", limit, "tag_name")


def projects(issues: DataFrame) -> DataFrame:
    return issues.select("project_key").distinct()
