"""Issues, commits and pull requests from JSON dumps of their services, and tasks from Markdown files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.rich_text import markdown_of
from spindrift.functions.text import issue_keys

# How file changes are named, by a git letter or a service's word.
FILE_STATUS = {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "added": "added", "modified": "modified",
               "removed": "deleted", "deleted": "deleted", "renamed": "renamed"}
DEFAULT_LINK = "Related"


def raw(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, as doc (text)."""
    return spark.read.text(path).withColumnRenamed("value", "doc").filter("trim(doc) <> ''")


def at(path: str, kind: str = "string", doc: str = "doc") -> Column:
    """The value at a path such as fields.status.name, null where it is missing or of another kind."""
    return F.try_variant_get(F.try_parse_json(doc), f"$.{path}", kind)


def each(path: str, field: str | None = None) -> Column:
    """The values of an array of texts, or of one field of an array of objects."""
    if field is None:
        return F.coalesce(at(path, "array<string>"), F.array().cast("array<string>"))
    found = at(path, f"array<struct<{field}:string>>")
    return F.coalesce(F.filter(F.transform(found, lambda x: x[field]), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def issues(rows: DataFrame) -> DataFrame:
    points = F.coalesce(at("fields.story_points", "double"), at("fields.customfield_10016", "double"))
    fields = F.from_json(F.get_json_object("doc", "$.fields"), "map<string,string>")
    custom = F.map_filter(fields, lambda k, v: k.startswith("customfield_") & v.isNotNull())
    seconds = lambda p: F.coalesce(at(p, "int"), at(p, "string").try_cast("int"))
    names = {"summary": "summary", "issue_type": "issuetype.name", "status": "status.name", "status_category": "status.statusCategory.name",
             "priority": "priority.name", "resolution": "resolution.name", "assignee": "assignee.displayName", "assignee_id": "assignee.accountId",
             "reporter": "reporter.displayName", "reporter_id": "reporter.accountId", "parent_key": "parent.key"}
    times = {"created": "created", "updated": "updated", "resolved": "resolutiondate"}
    return rows.select(
        at("key").alias("issue_key"), F.split(at("key"), "-")[0].alias("project_key"), at("id").alias("issue_id"),
        markdown_of(F.get_json_object("doc", "$.fields.description")).alias("description"),
        F.coalesce(at("fields.sprint.name"), at("fields.sprint")).alias("sprint"),
        *(at(f"fields.{v}").alias(k) for k, v in names.items()),
        *(at(f"fields.{v}").try_cast("timestamp").alias(k) for k, v in times.items()),
        at("fields.duedate").try_cast("date").alias("due_date"), points.alias("story_points"),
        seconds("fields.timeoriginalestimate").alias("original_estimate"), seconds("fields.timeestimate").alias("remaining_estimate"),
        seconds("fields.timespent").alias("time_spent"), each("fields.labels").alias("labels"),
        each("fields.components", "name").alias("components"), each("fields.fixVersions", "name").alias("fix_versions"),
        F.to_json(custom).alias("custom_fields"), F.col("doc").alias("raw_json"), F.lit("jira").alias("source"))


def changelogs(rows: DataFrame) -> DataFrame:
    """One row for each item of each history."""
    kind = "array<struct<created:string,author:struct<displayName:string>,items:array<struct<field:string,fromString:string,toString:string>>>>"
    h = rows.select(at("key").alias("issue_key"), F.explode(at("changelog.histories", kind)).alias("h"))
    i = h.select("issue_key", "h", F.explode("h.items").alias("i"))
    return i.select("issue_key", F.col("h.author.displayName").alias("author"), F.col("i.field").alias("field"),
                    F.col("i.fromString").alias("from_value"), F.col("i.toString").alias("to_value"), F.col("h.created").try_cast("timestamp").alias("changed_at"))


def links(rows: DataFrame) -> DataFrame:
    """Outward links from the issue, inward ones to it."""
    kind = "array<struct<type:struct<name:string>,outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>"
    l = rows.select(at("key").alias("k"), F.explode(at("fields.issuelinks", kind)).alias("l"))
    name = F.coalesce("l.type.name", F.lit(DEFAULT_LINK)).alias("link_type")
    out = l.filter("l.outwardIssue.key is not null").select(F.col("k").alias("source_key"), F.col("l.outwardIssue.key").alias("target_key"), name, F.lit("outward").alias("direction"))
    back = l.filter("l.inwardIssue.key is not null").select(F.col("l.inwardIssue.key").alias("source_key"), F.col("k").alias("target_key"), name, F.lit("inward").alias("direction"))
    return out.unionByName(back)


def _children(rows: DataFrame, path: str) -> DataFrame:
    """issue_key and doc (JSON text) of each element of an array."""
    found = F.from_json(F.get_json_object("doc", f"$.{path}"), "array<string>")
    return rows.select(at("key").alias("issue_key"), F.explode(found).alias("doc"))


def _time(name: str, alias: str | None = None) -> Column:
    return at(name).try_cast("timestamp").alias(alias or name)


def comments(rows: DataFrame) -> DataFrame:
    return _children(rows, "fields.comment.comments").select(
        "issue_key", F.coalesce(at("id"), F.lit("")).alias("comment_id"), at("author.displayName").alias("author"),
        markdown_of(F.get_json_object("doc", "$.body")).alias("body"), _time("created"), _time("updated"))


def worklogs(rows: DataFrame) -> DataFrame:
    return _children(rows, "fields.worklog.worklogs").select(
        "issue_key", at("author.displayName").alias("author"), at("timeSpent").alias("time_spent"),
        at("timeSpentSeconds", "int").alias("time_spent_seconds"), markdown_of(F.get_json_object("doc", "$.comment")).alias("comment"), _time("started"))


def file_status(status: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in FILE_STATUS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, status), F.lit("modified"))


def commit_refs(commits: DataFrame) -> DataFrame:
    return commits.select(F.col("hash").alias("commit_hash"), F.explode(issue_keys(F.col("message"))).alias("issue_key")).distinct()


def pull_requests(rows: DataFrame, repo: str) -> DataFrame:
    """State follows the merge time: merged, closed or else open; missing counts are 0."""
    count = lambda n: F.coalesce(at(n, "int"), F.lit(0)).alias(n)
    time = lambda n: at(n).try_cast("timestamp").alias(n)
    state = F.when(at("merged_at").isNotNull(), "merged").when(at("state") == "closed", "closed").otherwise("open")
    return rows.select(F.lit(repo).alias("repo_full_name"), at("number", "int").alias("number"), at("title").alias("title"), at("body").alias("body"),
                       state.alias("state"), at("user.login").alias("author"), *map(time, ("created_at", "updated_at", "merged_at", "closed_at")),
                       at("base.ref").alias("base_ref"), at("head.ref").alias("head_ref"), each("labels", "name").alias("labels"),
                       each("requested_reviewers", "login").alias("reviewers"), *map(count, ("additions", "deletions", "changed_files")))


def pr_refs(prs: DataFrame) -> DataFrame:
    keys = issue_keys(F.concat_ws(" ", "title", "body"))
    return prs.select("repo_full_name", F.col("number").alias("pr_number"), F.explode(keys).alias("issue_key")).distinct()


def _of_pr(repo: str) -> list[Column]:
    """Repository and number: the landed pr_number or else the one that pull_request_url ends with."""
    number = F.coalesce(at("pr_number", "int"), F.regexp_extract(at("pull_request_url"), r"/(\d+)$", 1).try_cast("int"))
    return [F.lit(repo).alias("repo_full_name"), number.alias("pr_number")]


def reviews(rows: DataFrame, repo: str) -> DataFrame:
    return rows.select(*_of_pr(repo), at("id", "long").alias("review_id"), at("user.login").alias("reviewer"), at("state").alias("state"),
                       at("body").alias("body"), _time("submitted_at"))


def review_comments(rows: DataFrame, repo: str) -> DataFrame:
    return rows.select(*_of_pr(repo), at("id", "long").alias("comment_id"), at("user.login").alias("author"), at("body").alias("body"),
                       at("path").alias("path"), at("line", "int").alias("line"), _time("created_at"), _time("updated_at"))


def pr_files(rows: DataFrame, repo: str) -> DataFrame:
    """Missing counts are 0; a status of another name is a modification."""
    count = lambda n: F.coalesce(at(n, "int"), F.lit(0)).alias(n)
    return rows.select(*_of_pr(repo), at("filename").alias("file_path"), file_status(at("status")).alias("status"), count("additions"), count("deletions"))


def releases(rows: DataFrame, repo: str) -> DataFrame:
    flag = lambda n: F.coalesce(at(n, "boolean"), F.lit(False)).alias(n)
    return rows.select(F.lit(repo).alias("repo_full_name"), at("id", "long").alias("id"), at("tag_name").alias("tag_name"), at("name").alias("name"),
                       at("body").alias("body"), at("author.login").alias("author"), flag("draft"), flag("prerelease"),
                       _time("created_at"), _time("published_at"), F.col("doc").alias("raw_json"))


def board_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks from Markdown files: the first heading is the title; front matter and folders tell the rest."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    key = lambda name: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    title = F.coalesce(F.nullif(F.trim(F.regexp_extract("value", r"(?m)^# (.*)$", 1)), F.lit("")), F.lit("Untitled"))
    jira = F.when(~key("jira_key").contains("NEXT"), key("jira_key"))
    parts = F.split("path", "/")
    return files.select("path", title.alias("title"), F.coalesce(key("status"), F.element_at(parts, -3)).alias("column_name"),
                        F.element_at(parts, -2).alias("epic"), jira.alias("jira_key"), key("assignee").alias("assignee"))


def imports(spark: SparkSession, folder: str, glob: str = "*.{ts,tsx,js,jsx,mjs,cjs,mts,cts}") -> DataFrame:
    """(path, target) for each relative import or require in source files."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    found = F.regexp_extract_all("value", F.lit(r"(?:import[^'\"]*?from\s*|require\(\s*)['\"](\.[^'\"]*)['\"]"), F.lit(1))
    return files.select(F.input_file_name().alias("path"), F.explode(F.array_distinct(found)).alias("target"))


def packages(spark: SparkSession, manifest: str) -> DataFrame:
    """Names of a manifest's dependencies of both kinds."""
    doc = spark.read.text(manifest, wholetext=True).withColumnRenamed("value", "doc")
    names = [F.coalesce(F.map_keys(F.from_json(F.get_json_object("doc", f"$.{k}"), "map<string,string>")), F.array().cast("array<string>"))
             for k in ("dependencies", "devDependencies")]
    return doc.select(F.explode(F.array_union(*names)).alias("package"))
