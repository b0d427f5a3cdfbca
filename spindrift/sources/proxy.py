"""Issues of proxied trackers, whose fields are named by paths such as fields.components[].name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where each field stands unless a mapping says otherwise.
PATHS = {
    "issue_key": "key", "summary": "fields.summary", "description": "fields.description", "status": "fields.status.name",
    "status_category": "fields.status.statusCategory.name", "issue_type": "fields.issuetype.name", "priority": "fields.priority.name",
    "resolution": "fields.resolution.name", "assignee": "fields.assignee.displayName", "assignee_id": "fields.assignee.accountId",
    "reporter": "fields.reporter.displayName", "reporter_id": "fields.reporter.accountId", "created": "fields.created",
    "updated": "fields.updated", "resolved": "fields.resolutiondate", "due_date": "fields.duedate", "labels": "fields.labels",
    "components": "fields.components[].name", "fix_versions": "fields.fixVersions[].name", "parent_key": "fields.parent.key",
    "sprint": "fields.sprint.name", "story_points": "fields.story_points",
}
LISTS = ("labels", "components", "fix_versions")
TIMES = ("created", "updated", "resolved")


def _under(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant") if path else value


def found(value: Column, path: str) -> Column:
    """The variants at a path, as an array: one for each element where the path goes through [], else at most one."""
    head, through, rest = path.partition("[]")
    if not through:
        return F.filter(F.array(_under(value, path)), lambda v: v.isNotNull())
    inner = F.try_variant_get(value, f"$.{head}", "array<variant>")
    rest = rest.lstrip(".")
    each = F.flatten(F.transform(inner, lambda v: found(v, rest))) if "[]" in rest else F.transform(inner, lambda v: _under(v, rest))
    return F.coalesce(F.filter(each, lambda v: v.isNotNull()), F.array().cast("array<variant>"))


def text(value: Column, path: str) -> Column:
    """Text as it is; numbers and truth values as text; objects and arrays as JSON."""
    values = found(value, path)
    if "[]" in path:
        return F.when(F.try_variant_get(value, f"$.{path.partition('[]')[0]}", "array<variant>").isNotNull(), F.to_json(values))
    return F.try_variant_get(F.get(values, F.lit(0)), "$", "string")


def number(value: Column, path: str) -> Column:
    """Numbers only; a text of digits is null."""
    one = F.get(found(value, path), F.lit(0))
    return F.when(F.schema_of_variant(one).rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(one, "$", "double"))


def texts(value: Column, path: str) -> Column:
    """The texts of an array; elements of other kinds are left out."""
    values = found(value, path) if "[]" in path else F.coalesce(F.try_variant_get(value, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))
    return F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))


def issues(rows: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Issues from doc (JSON text); estimates and custom fields are not there."""
    paths = PATHS | (mapping or {})
    rows = rows.select("doc", F.try_parse_json("doc").alias("v"))
    v = F.col("v")
    cells = {n: texts(v, p) if n in LISTS else number(v, p) if n == "story_points" else text(v, p) for n, p in paths.items()}
    cells |= {n: cells[n].try_cast("timestamp") for n in TIMES} | {"due_date": cells["due_date"].try_cast("date")}
    cells |= {n: F.coalesce(cells[n], F.lit("")) for n in ("issue_key", "summary")}
    return rows.select(*(c.alias(n) for n, c in cells.items()), F.coalesce(text(v, "id"), F.lit("")).alias("issue_id"),
                       F.split(cells["issue_key"], "-")[0].alias("project_key"), F.col("doc").alias("raw_json"), F.lit("jira").alias("source"))


def with_descriptions(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Issues whose missing descriptions come from (issue_key, description) rows fetched one by one."""
    more = details.groupBy("issue_key").agg(F.max("description").alias("_more"))
    return rows.join(more, "issue_key", "left").withColumn("description", F.coalesce("description", "_more")).select(*rows.columns)
