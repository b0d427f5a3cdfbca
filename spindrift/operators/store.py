"""Keyed upserts on table snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EDITABLE = ("summary", "description", "issue_type", "status", "priority", "assignee", "labels", "components")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key, the last by order; of equally late ones the one with the largest hash of its columns."""
    hashed = [c for c, kind in rows.dtypes if not kind.startswith(("map", "variant"))]
    latest = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc(F.xxhash64(*(F.col(f"`{c}`") for c in hashed))))
    return rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def _without(old: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """old without the rows of those keys; null keys equal one another."""
    gone = keys.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(names)))
    same = [old[k].eqNullSafe(gone[f"_k{i}"]) for i, k in enumerate(names)]
    return old.join(gone, same, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """old with new's rows in place of those of the same key. Columns in keep stay as they were where they were set.

    Where new repeats a key, null ones included, the last row by order stays, or any one without an order.
    """
    rows = new = last_of(new, keys, order) if order else new.dropDuplicates(keys)
    if keep:
        before = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in keep))
        rows = new.join(before, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in keep}).select(*old.columns)
    return _without(old, new, keys).unionByName(rows)


def replace_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str | list[str]) -> DataFrame:
    """old without the children of parents, and new."""
    keys = [key] if isinstance(key, str) else key
    return _without(old, parents.select(*keys).distinct(), keys).unionByName(new)


#: Per kind of batch: its parent table and key, and its child tables with the columns that name the parent.
BATCHES = {
    "issues": ("issues", ["issue_key"], {"issue_comments": ["issue_key"], "issue_changelogs": ["issue_key"], "issue_worklogs": ["issue_key"],
                                         "issue_links": ["source_key"]}),
    "commits": ("commits", ["hash"], {"commit_files": ["commit_hash"], "commit_issue_refs": ["commit_hash"]}),
    "pull_requests": ("pull_requests", ["repo_full_name", "number"], {
        t: ["repo_full_name", "pr_number"] for t in ("pr_reviews", "pr_comments", "pr_files", "pr_issue_refs")}),
    "releases": ("releases", ["repo_full_name", "id"], {}),
}
#: Keys of the catalog tables, which a batch upserts side by side.
CATALOG = {
    "db_tables": ["source_name", "schema_name", "table_name"], "db_columns": ["source_name", "table_name", "column_name"],
    "db_foreign_keys": ["source_name", "table_name", "column_name", "referenced_table", "referenced_column"],
    "db_indexes": ["source_name", "table_name", "index_name"],
}


def save_batch(kind: str, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a batch: parents upserted, and all children of the batch's parents replaced by the batch's.

    Child tables that the batch lacks lose those parents' rows. References are kept once.
    """
    parent, keys, children = BATCHES[kind]
    out = {parent: upsert(old[parent], new[parent], keys)}
    for child, names in children.items():
        parents = new[parent].select(*(F.col(k).alias(n) for k, n in zip(keys, names)))
        rows = new.get(child, old[child].limit(0))
        out[child] = replace_children(old[child], rows.distinct() if child.endswith("_refs") else rows, parents, names)
    return out


def save_schema(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {t: upsert(old[t], new[t], CATALOG[t]) for t in CATALOG if t in new}


def delete_schema(tables: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The catalog tables without one source."""
    return {t: tables[t].filter(~F.col("source_name").eqNullSafe(source)) for t in CATALOG if t in tables}


def save_embeddings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(issue_key, embedding) rows in place of those of the same key."""
    return upsert(old, new, ["issue_key"])


def update_source(issues: DataFrame, key: str, source: str) -> DataFrame:
    return issues.withColumn("source", F.when(F.col("issue_key") == key, source).otherwise(F.col("source")))


def save_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Graph entities by name and type; the new properties stay."""
    return upsert(old, new, ["name", "type"])


def observations_of(observations: DataFrame, entity: str) -> DataFrame:
    """Notes on the entities of a name, oldest first."""
    return observations.filter(F.col("name") == entity).orderBy(F.col("created_at").asc_nulls_last(), "content")


def initialize(spark, path: str, schemas: dict[str, str]) -> None:
    """Empty Parquet tables for those that a workspace folder lacks; running it again changes nothing."""
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/{name}.parquet")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def high_water(rows: DataFrame, key: str, at: str) -> DataFrame:
    """Per key, when to read from next: the latest time less a minute."""
    return rows.groupBy(key).agg(F.max(at).alias("latest")).withColumn("since", F.expr("latest - interval 60 seconds"))


def update_fields(issues: DataFrame, key: str, fields: dict, asof: str) -> DataFrame:
    """issues with some fields of one changed and marked as changed; no fields, no change."""
    unknown = set(fields) - set(EDITABLE)
    if unknown:
        raise ValueError(f"not editable: {sorted(unknown)}")
    if not fields:
        return issues
    here = F.col("issue_key") == key
    if issues.filter(here).isEmpty():
        raise KeyError(key)
    marks = {"locally_modified": F.lit(True), "modified_at": F.lit(asof).cast("timestamp_ntz"), "modified_fields": F.array(*map(F.lit, sorted(fields)))}
    values = {k: F.lit(v).cast(issues.schema[k].dataType) for k, v in fields.items()} | marks
    return issues.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in values.items()})


def local_issues(issues: DataFrame) -> DataFrame:
    return issues.filter("source = 'local'").orderBy(F.col("created").asc_nulls_last(), "issue_key")


def modified_issues(issues: DataFrame) -> DataFrame:
    return issues.filter("locally_modified").orderBy(F.col("modified_at").asc_nulls_last(), "issue_key")


def clear_modified(issues: DataFrame, key: str) -> DataFrame:
    return issues.withColumn("locally_modified", F.when(F.col("issue_key") == key, False).otherwise(F.col("locally_modified")))


def unembedded(issues: DataFrame, limit: int) -> DataFrame:
    return issues.filter("embedding is null").orderBy(F.col("updated").desc_nulls_last(), "issue_key").limit(limit).select("issue_key")
