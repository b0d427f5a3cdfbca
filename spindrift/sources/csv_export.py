"""Issues from a tracker's CSV export, whose headers repeat and whose rows are ragged.

The header row alone is read on the driver; every row is an array of cells.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.rendering import format_time_spent

# Headers that an export repeats for each value.
REPEATED = ("Log Work", "Comment", "Attachment", "Watchers", "Watchers Id", "Fix versions", "Components", "Labels")
# Headers of links, custom fields and points as exports write them.
LINK = re.compile(r"(Inward|Outward) issue link \((.+)\)")
CUSTOM = re.compile(r"Custom field \((.+)\)")
POINTS = ("Story Points", "Story point estimate")
# English month names as exports shorten them.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


@dataclass
class Layout:
    """Where an export has what: columns by header, runs of repeated headers, links and custom fields."""

    standard: dict[str, int] = field(default_factory=dict)
    repeated: dict[str, tuple[int, int]] = field(default_factory=dict)
    links: list[tuple[str, str, int]] = field(default_factory=list)
    custom: list[tuple[str, int]] = field(default_factory=list)

    @classmethod
    def of(cls, headers: list[str]) -> Layout:
        out = cls()
        for i, name in enumerate(h.strip() for h in headers):
            if link := LINK.fullmatch(name):
                out.links.append((link[1].lower(), link[2], i))
            elif custom := CUSTOM.fullmatch(name):
                out.custom.append((custom[1], i))
            elif name in REPEATED:
                start, n = out.repeated.get(name, (i, 0))
                out.repeated[name] = (start, n + 1)
            elif name:
                out.standard.setdefault(name, i)
        return out


def read(spark: SparkSession, path: str, since: str | None = None) -> tuple[DataFrame, Layout]:
    """Rows as cells (an array), without the header and empty lines; older updates than since are left out."""
    options = {"multiLine": True, "escape": '"', "header": False}
    lines = spark.read.text(path)
    head = lines.filter("trim(value) <> ''").first()
    headers = next(csv.reader([head.value])) if head else []
    names = [f"c{i}" for i in range(max(1, len(headers)))]
    schema = ", ".join(f"{n} string" for n in names)
    rows = spark.read.options(**options).schema(schema).csv(path)
    layout = Layout.of(headers)
    key = layout.standard.get("Issue key", 0)
    rows = rows.select(F.array(*names).alias("cells")).filter(F.coalesce(F.col("cells")[key], F.lit("")) != "Issue key")
    rows = rows.filter(F.exists("cells", lambda c: F.trim(c) != ""))
    if since:
        updated = jira_date(cell(layout.standard.get("Updated")))
        rows = rows.filter(updated.isNull() | (updated >= F.lit(since).cast("timestamp_ntz")))
    return rows, layout


def cell(index: int | None) -> Column:
    """A trimmed cell; empty and missing ones are null."""
    return F.lit(None).cast("string") if index is None else F.nullif(F.trim(F.get("cells", F.lit(index))), F.lit(""))


def jira_date(text: Column) -> Column:
    """d/MMM/yy h:mm AM or PM, in UTC; years from 70 are of the last century, unknown months January, all else null."""
    part = lambda i: F.nullif(F.regexp_extract(text, r"^(\d{1,2})/(\w{3})/(\d{2}) (\d{1,2}):(\d{2}) (AM|PM)$", i), F.lit(""))
    year = part(3).cast("int") + F.when(part(3).cast("int") >= 70, 1900).otherwise(2000)
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), part(2)), F.lit(0)), F.lit(1)).cast("int")
    hour = part(4).cast("int") % 12 + F.when(part(6) == "PM", 12).otherwise(0)
    written = F.format_string("%04d-%02d-%02d %02d:%s:00", year, month, part(1).cast("int"), hour, part(5))
    return F.when(part(1).isNotNull(), written.try_cast("timestamp_ntz"))


def values(layout: Layout, name: str) -> Column:
    """The non-empty cells of a repeated header, counted from its first column on."""
    if name not in layout.repeated:
        return F.array().cast("array<string>")
    start, n = layout.repeated[name]
    cells = F.transform(F.slice("cells", start + 1, n), lambda c: F.trim(c))
    return F.filter(cells, lambda c: c.isNotNull() & (c != ""))


def issues(rows: DataFrame, layout: Layout) -> DataFrame:
    std = lambda name: cell(layout.standard.get(name))
    whole = lambda name: F.regexp_extract(std(name), r"^\s*([+-]?\d+)", 1).try_cast("int")
    points = [cell(i).try_cast("double") for name, i in layout.custom if name in POINTS]
    custom = F.create_map(*(x for name, i in layout.custom for x in (F.lit(name), cell(i)))) if layout.custom else F.create_map().cast("map<string,string>")
    key = F.coalesce(std("Issue key"), F.lit(""))
    text = {"issue_id": "Issue id", "summary": "Summary", "description": "Description", "issue_type": "Issue Type", "status": "Status",
            "status_category": "Status Category", "priority": "Priority", "resolution": "Resolution", "assignee": "Assignee",
            "assignee_id": "Assignee Id", "reporter": "Reporter", "reporter_id": "Reporter Id", "parent_key": "Parent key", "sprint": "Sprint",
            "due_date": "Due date"}
    times = {"created": "Created", "updated": "Updated", "resolved": "Resolved"}
    numbers = {"original_estimate": "Original estimate", "remaining_estimate": "Remaining Estimate", "time_spent": "Time Spent"}
    lists = {"labels": "Labels", "components": "Components", "fix_versions": "Fix versions"}
    return rows.select(
        key.alias("issue_key"), F.split(key, "-")[0].alias("project_key"), *(std(v).alias(k) for k, v in text.items()),
        *(jira_date(std(v)).alias(k) for k, v in times.items()), *(whole(v).alias(k) for k, v in numbers.items()),
        *(values(layout, v).alias(k) for k, v in lists.items()),
        (F.coalesce(*points) if points else F.lit(None).cast("double")).alias("story_points"),
        F.to_json(F.map_filter(custom, lambda k, v: v.isNotNull())).alias("custom_fields"), F.lit("jira").alias("source"))


def _key(layout: Layout) -> Column:
    return F.coalesce(cell(layout.standard.get("Issue key")), F.lit("")).alias("issue_key")


def comments(rows: DataFrame, layout: Layout) -> DataFrame:
    """Cells of time;author;body; the body may hold semicolons."""
    c = rows.select(_key(layout), F.explode(values(layout, "Comment")).alias("c")).select("issue_key", F.split("c", ";", 3).alias("p"))
    blank = lambda i: F.nullif(F.col("p")[i], F.lit(""))
    return c.filter(F.size("p") == 3).select("issue_key", blank(1).alias("author"), blank(2).alias("body"), jira_date(F.col("p")[0]).alias("created"))


def worklogs(rows: DataFrame, layout: Layout) -> DataFrame:
    """Cells of description;time;author;...;seconds."""
    w = rows.select(_key(layout), F.explode(values(layout, "Log Work")).alias("c")).select("issue_key", F.split("c", ";").alias("p"))
    seconds = F.regexp_extract(F.element_at("p", -1), r"^\s*([+-]?\d+)", 1).try_cast("int")
    blank = lambda i: F.nullif(F.col("p")[i], F.lit(""))
    return w.filter(F.size("p") >= 4).select("issue_key", blank(2).alias("author"), seconds.alias("time_spent_seconds"),
                                             format_time_spent(seconds).alias("time_spent"), blank(0).alias("comment"), jira_date(F.col("p")[1]).alias("started"))


def links(rows: DataFrame, layout: Layout) -> DataFrame:
    """Distinct links; an inward one goes from the other issue to this one."""
    if not layout.links:
        return rows.sparkSession.createDataFrame([], "source_key string, target_key string, link_type string, direction string")
    each = [F.struct(cell(i).alias("other"), F.lit(kind).alias("link_type"), F.lit(way).alias("direction")) for way, kind, i in layout.links]
    l = rows.select(_key(layout), F.explode(F.array(*each)).alias("l")).filter("l.other is not null")
    inward = F.col("l.direction") == "inward"
    return l.select(F.when(inward, F.col("l.other")).otherwise(F.col("issue_key")).alias("source_key"),
                    F.when(inward, F.col("issue_key")).otherwise(F.col("l.other")).alias("target_key"), "l.link_type", "l.direction").distinct()
