"""Counts over issues, commits and database catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import has


def grouped_counts(df: DataFrame, columns: list[str], top: dict[str, int] | None = None) -> DataFrame:
    """(facet, value, n): the total and the counts by each column, in one pass over df.

    top names how many of a column's most frequent values stay.
    """
    sets = [F.struct(F.lit("total").alias("facet"), F.lit(None).cast("string").alias("value"))] + [
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = df.select(F.explode(F.array(*sets)).alias("s")).groupBy("s.facet", "s.value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), F.col("value").asc_nulls_last()))
    keep = F.lit(True)
    for column, k in (top or {}).items():
        keep = keep & ((F.col("facet") != column) | (F.col("place") <= k))
    return counts.withColumn("place", place).filter(keep).drop("place")


def issue_stats(issues: DataFrame, project: str | None = None) -> DataFrame:
    if project:
        return grouped_counts(issues.filter(F.col("project_key") == project.upper()), ["status", "issue_type", "assignee"], {"assignee": 15})
    return grouped_counts(issues, ["status", "issue_type", "project_key", "assignee"], {"assignee": 15})


def commit_stats(commits: DataFrame, files: DataFrame, refs: DataFrame, since: str | None = None, author: str | None = None,
                 repo_path: str | None = None) -> DataFrame:
    """(facet, value, n): commits, the 15 busiest authors and files, and how many issues any commit names."""
    where = F.lit(True)
    if since:
        where = where & (F.col("committed_at") >= F.lit(since).cast("timestamp_ntz"))
    if author:
        where = where & has("author", author)
    if repo_path:
        where = where & has("repo_path", repo_path)
    chosen = commits.filter(where)
    by_author = grouped_counts(chosen, ["author"], {"author": 15})
    touched = files.join(chosen, files["commit_hash"] == chosen["hash"], "left_semi")
    by_file = grouped_counts(touched, ["file_path"], {"file_path": 15}).filter("facet = 'file_path'")
    linked = refs.agg(F.lit("linked_issues").alias("facet"), F.lit(None).cast("string").alias("value"),
                      F.count_distinct("issue_key").alias("n"))
    return by_author.unionByName(by_file).unionByName(linked)


def db_stats(tables: DataFrame, columns: DataFrame, keys: DataFrame, indexes: DataFrame, source: str | None = None) -> DataFrame:
    """(facet, value, n, row_count): totals of each catalog table, tables by schema, and the ten largest."""
    mine = lambda df: df.filter(F.col("source_name") == source) if source else df
    none = F.lit(None).cast("string")
    out = None
    for name, df in (("tables", tables), ("columns", columns), ("foreign_keys", keys), ("indexes", indexes)):
        row = mine(df).agg(F.lit(name).alias("facet"), none.alias("value"), F.count("*").alias("n"), F.lit(None).cast("long").alias("row_count"))
        out = row if out is None else out.unionByName(row)
    schemas = mine(tables).groupBy("schema_name").agg(F.count("*").alias("n"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"))
    largest = mine(tables).withColumn("row_count", F.coalesce("row_count", F.lit(0))).orderBy(F.desc("row_count"), "schema_name", "table_name").limit(10)
    return (out.unionByName(schemas.select(F.lit("schema").alias("facet"), F.col("schema_name").alias("value"), "n", "row_count"))
            .unionByName(largest.select(F.lit("largest").alias("facet"), F.col("table_name").alias("value"), F.lit(1).cast("long").alias("n"), "row_count")))


def db_schema(tables: DataFrame, columns: DataFrame, keys: DataFrame, indexes: DataFrame, table: str | None = None,
              schema: str | None = None, source: str | None = None, limit: int = 200) -> DataFrame:
    """Tables by filters, each with its columns, foreign keys and indexes as lists."""
    where = F.lit(True)
    if source:
        where = where & (F.col("source_name") == source)
    if schema:
        where = where & (F.col("schema_name") == schema)
    if table:
        where = where & has("table_name", table)
    out = tables.filter(where).orderBy("schema_name", "table_name").limit(limit)
    on = ["source_name", "table_name"]
    parts = (("columns", columns, ("ordinal_position", "column_name", "data_type", "is_nullable", "is_primary_key"), [*on, "schema_name"]),
             ("foreign_keys", keys, ("column_name", "referenced_table", "referenced_column"), on),
             ("indexes", indexes, ("index_name", "columns", "is_unique", "is_primary"), on))
    for name, df, fields, by in parts:
        listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(listed, by, "left")
    return out
