"""Duration estimates from similar finished work.

Every step is a table. ``asof`` stands for the present, so that results can be
repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.rendering import business_hours
from spindrift.functions.text import has
from spindrift.operators.postings import ranked_texts
from spindrift.session import settled

YEAR_S = 86400.0 * 365
BUGS = ("Bug", "Sub-bug")


def overlap(components: Column, wanted: list[str]) -> Column:
    """Share of the wanted components that are there; repeated ones count each time."""
    if not wanted:
        return F.lit(0.0)
    return F.size(F.filter(F.array(*map(F.lit, wanted)), lambda w: F.array_contains(F.coalesce(components, F.array()), w))) / len(wanted)


def seconds_between(a: Column, b: Column) -> Column:
    """From a to b."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def scored(issues: DataFrame, relevance: Column, asof: str, issue_type: str | None = None, components: list[str] | None = None) -> DataFrame:
    """issues with type_match, component_overlap, temporal_weight and composite_score."""
    age = seconds_between(F.coalesce("resolved", "updated"), F.lit(asof).cast("timestamp_ntz"))
    parts = {"type_match": F.when(F.col("issue_type") == issue_type, 1.0).otherwise(0.0) if issue_type else F.lit(0.0),
             "component_overlap": overlap(F.col("components"), components or []),
             "temporal_weight": 1.0 / (1.0 + age / YEAR_S)}
    rows = issues.withColumns(parts)
    score = (F.least(relevance * 10, F.lit(1.0)) * 0.3 + F.col("type_match") * 0.25 + F.col("component_overlap") * 0.35
             + F.col("temporal_weight") * 0.1)
    return rows.withColumn("composite_score", score)


def similar(issues: DataFrame, description: str, asof: str, issue_type: str | None = None, components: list[str] | None = None,
            exclude_key: str | None = None, limit: int = 10, stemmed: bool = False) -> DataFrame:
    """The most similar finished issues; where no text matches, the most recently resolved ones."""
    rows = issues if exclude_key is None else issues.filter(F.col("issue_key") != exclude_key)
    done = rows.filter((F.col("status_category") == "Done") & (F.col("status") != "Canceled"))
    hits = ranked_texts(done.select("issue_key", F.concat_ws(" ", "summary", "description").alias("_text")), "issue_key", "_text", description, stemmed)
    matched = done.join(hits.select(F.col("key").alias("issue_key"), F.col("hits").alias("_hits")), "issue_key")
    found = scored(matched, F.col("_hits"), asof, issue_type, components).orderBy(F.desc("composite_score"), "issue_key").limit(limit).drop("_hits")
    found = settled(found, "similar")  # a few rows that every later step reads
    if not found.isEmpty():
        return found
    recent = rows.filter("resolved is not null").orderBy(F.desc("resolved"), "issue_key").limit(limit)
    return settled(recent.withColumns({"type_match": F.lit(0.0), "component_overlap": F.lit(0.0), "temporal_weight": F.lit(0.5),
                                       "composite_score": F.lit(0.0)}).select(*found.columns), "similar")


def worklog_sums(worklogs: DataFrame) -> DataFrame:
    return worklogs.groupBy("issue_key", "author").agg(F.sum("time_spent_seconds").alias("seconds"))


def first_by(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value) of each key's earliest row, null times last."""
    order = Window.partitionBy(key).orderBy(F.col(at).asc_nulls_last(), value)
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(key, value)


def real_developers(changelogs: DataFrame) -> DataFrame:
    """Who each issue was first assigned to."""
    return first_by(changelogs.filter((F.col("field") == "assignee") & (F.coalesce("to_value", F.lit("")) != "")), "issue_key", "to_value", "changed_at")


def commit_rollup(refs: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """Per issue: commits, their authors, lines, and the span of their times. Files are summed before the join."""
    lines = files.groupBy("commit_hash").agg(F.sum("additions").alias("additions"), F.sum("deletions").alias("deletions"))
    joined = refs.join(commits, refs["commit_hash"] == commits["hash"]).select("issue_key", "hash", "author", "committed_at")
    joined = joined.join(lines, joined["hash"] == lines["commit_hash"], "left")
    return joined.groupBy("issue_key").agg(
        F.count("*").alias("commits"), F.array_join(F.array_sort(F.collect_set("author")), ", ").alias("authors"),
        F.coalesce(F.sum("additions"), F.lit(0)).alias("additions"), F.coalesce(F.sum("deletions"), F.lit(0)).alias("deletions"),
        F.min("committed_at").alias("first_commit"), F.max("committed_at").alias("last_commit"))


def related_bugs(issues: DataFrame, links: DataFrame, keys: DataFrame) -> DataFrame:
    """(parent, issue_key): children and linked issues of keys, without those among keys themselves."""
    of = keys.select(F.col("issue_key").alias("parent"))
    children = issues.join(of, issues["parent_key"] == of["parent"]).select("parent", "issue_key")
    linked = links.join(of, links["source_key"] == of["parent"]).select("parent", F.col("target_key").alias("issue_key"))
    linked = linked.join(issues.select("issue_key"), "issue_key", "left_semi").select("parent", "issue_key")
    return children.unionByName(linked).join(keys.select("issue_key"), "issue_key", "left_anti").select("parent", "issue_key")


def familiarity(issues: DataFrame, assignee: str) -> DataFrame:
    """Per component: finished issues with logged time, their mean hours, the last one's date."""
    done = issues.filter(has("assignee", assignee) & (F.col("status_category") == "Done") & (F.col("time_spent") > 0))
    return (done.select("issue_key", "time_spent", "resolved", F.explode("components").alias("component")).groupBy("component")
            .agg(F.count_distinct("issue_key").alias("resolved_count"), (F.avg("time_spent") / 3600).alias("avg_time_hours"),
                 F.max("resolved").alias("last_resolved")))


def familiarity_factor(known: DataFrame, components: list[str]) -> DataFrame:
    """One row: 1 less 0.08 for each resolved issue in the components, from 0.6 to 1."""
    mine = known.filter(F.lower("component").isin(*[c.lower() for c in components])) if components else known.limit(0)
    return mine.agg(F.greatest(F.lit(0.6), F.least(F.lit(1.0), 1.0 - 0.08 * F.coalesce(F.sum("resolved_count"), F.lit(0)))).alias("factor"))


def coefficients(issues: DataFrame, links: DataFrame, types: list[str] | None = None, least: int = 3) -> DataFrame:
    """Per assignee with enough issues: median of actual over estimated time, the same with bugs' time, and bugs' mean share."""
    base = issues.filter((F.col("status_category") == "Done") & (F.col("original_estimate") > 0) & (F.col("time_spent") > 0)
                         & ~F.col("issue_type").isin(*BUGS) & (F.col("time_spent") / F.col("original_estimate") < 5))
    if types:
        base = base.filter(F.col("issue_type").isin(*types))
    bugs = issues.filter(F.col("issue_type").isin(*BUGS) & (F.col("time_spent") > 0))
    by_parent = bugs.filter("parent_key is not null").select(F.col("parent_key").alias("owner"), "time_spent")
    once = links.select("source_key", "target_key", "link_type").distinct()
    by_link = once.join(bugs, once["target_key"] == bugs["issue_key"]).select(F.col("source_key").alias("owner"), "time_spent")
    spent = by_parent.unionByName(by_link).groupBy("owner").agg(F.sum("time_spent").alias("bug_time"))
    rows = base.join(spent, base["issue_key"] == spent["owner"], "left").withColumn("bug_time", F.coalesce("bug_time", F.lit(0)))
    actual = F.col("time_spent") / F.col("original_estimate")
    with_bugs = (F.col("time_spent") + F.col("bug_time")) / F.col("original_estimate")
    return (rows.withColumns({"_a": actual, "_b": with_bugs}).groupBy("assignee")
            .agg(F.count_distinct("issue_key").alias("tasks"), F.percentile("_a", 0.5).alias("coefficient"),
                 F.percentile("_b", 0.5).alias("coefficient_with_bugs"), F.avg(F.col("bug_time") / F.col("time_spent")).alias("bug_ratio"))
            .filter(F.col("tasks") >= least))


def with_fallback(context: DataFrame, general: DataFrame) -> DataFrame:
    """context, and of general the assignees that context lacks. As with NOT IN, a null assignee in context keeps all of general out."""
    known = context.select(F.col("assignee").alias("known"))
    rest = general.crossJoin(F.broadcast(known.agg(F.max(F.col("known").isNull()).alias("_null"), F.count("*").alias("_n"))))
    rest = rest.filter((F.col("_n") == 0) | (~F.col("_null") & F.col("assignee").isNotNull())).drop("_null", "_n")
    return context.withColumn("source", F.lit("context")).unionByName(
        rest.join(known, rest["assignee"] == known["known"], "left_anti").withColumn("source", F.lit("general")))


def task_hours(rows: DataFrame) -> DataFrame:
    """rows with hours and cycle_only. Logged time comes first, then worklogs, the span of commits, the estimate, and working hours."""
    hours = lambda c: F.nullif(F.col(c) / 3600.0, F.lit(0.0))
    span = F.nullif(seconds_between(F.col("first_commit"), F.col("last_commit")) / 3600.0, F.lit(0.0))
    known = F.coalesce(hours("time_spent"), hours("worklog_seconds"), span, hours("original_estimate"))
    cycle = business_hours(F.col("created"), F.col("resolved")).cast("double")
    return (rows.withColumns({"cycle_only": known.isNull(), "hours": F.coalesce(known, cycle)}).filter(F.col("hours") > 0))


def base_hours(tasks: DataFrame, by: list[str]) -> DataFrame:
    """Per group of tasks (hours, weight): how many, and the weighted mean.

    Of more than five, a tenth at each end, at least one task, is left out;
    weights that sum to nothing count alike.
    """
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy("hours", "weight"))
    n = F.count("*").over(Window.partitionBy(*by))
    cut = F.when(F.col("_n") > 5, F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).otherwise(F.lit(0))
    kept = tasks.withColumns({"_place": place, "_n": n}).filter((F.col("_place") > cut) & (F.col("_place") <= F.col("_n") - cut))
    weights = F.sum("weight")
    return kept.groupBy(*by).agg(F.max("_n").alias("tasks"), F.when(weights == 0, F.avg("hours")).otherwise(
        F.sum(F.col("hours") * F.col("weight")) / F.nullif(weights, F.lit(0.0))).alias("base_hours"))


def profiles(tasks: DataFrame) -> DataFrame:
    """Per developer: tasks, cycle hours, coding hours, bugs and commits."""
    who = F.coalesce("first_assignee", "worklog_author", "commit_authors", "assignee", F.lit("unknown"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return tasks.withColumn("developer", who).groupBy("developer").agg(
        F.count("*").alias("tasks"), *map(total, ("cycle_hours", "coding_hours", "bugs", "commits")))


#: Outcomes of a prediction.
RANGE, NOTHING, PREDICTED = "range", "none", "predicted"


def predictions(requests: DataFrame, tasks: DataFrame, chosen: DataFrame, assignee: str, by: list[str]) -> DataFrame:
    """For each request, by the columns in by, one of three outcomes from its tasks (hours, weight, cycle_only).

    Where all tasks have cycle times only, the range of these in working days. Where there are no hours, nothing. Else the
    base hours times the coefficients of the assignee: of the first context row that names them, else the first general one, else none.
    """
    known = base_hours(tasks, by)
    spans = tasks.groupBy(*by).agg(F.min("cycle_only").alias("_cycle"), F.min("hours").alias("_least"), F.max("hours").alias("_most"))
    own = (chosen.filter(has("assignee", assignee)).orderBy("source", "assignee").limit(1)
           .select(F.lit(1).alias("_one"), "coefficient", "coefficient_with_bugs", F.col("source").alias("coefficient_source")))
    rows = (requests.select(*by).distinct().join(known, by, "left").join(spans, by, "left").withColumn("_one", F.lit(1))
            .join(F.broadcast(own), "_one", "left"))
    mode = F.when(F.coalesce("_cycle", F.lit(False)), RANGE).when(F.coalesce("base_hours", F.lit(0.0)) == 0, NOTHING).otherwise(PREDICTED)
    rows = rows.withColumn("mode", mode)
    only = lambda m, c: F.when(F.col("mode") == m, c)
    times = lambda c: F.col("base_hours") * F.coalesce(c, F.lit(1.0))
    return rows.select(*by, "mode", F.coalesce("tasks", F.lit(0)).cast("long").alias("tasks"), only(PREDICTED, F.col("base_hours")).alias("base_hours"),
                       only(RANGE, F.round(F.col("_least") / 8)).cast("long").alias("least_days"), only(RANGE, F.round(F.col("_most") / 8)).cast("long").alias("most_days"),
                       *(only(PREDICTED, F.col(c)).alias(c) for c in ("coefficient", "coefficient_with_bugs", "coefficient_source")),
                       only(PREDICTED, times("coefficient")).alias("predicted_hours"), only(PREDICTED, times("coefficient_with_bugs")).alias("predicted_hours_with_bugs"))


def measured(tables: dict[str, DataFrame], found: DataFrame) -> DataFrame:
    """Similar issues with what is known of each: worklogs, commits, bugs, first assignee, cycle and coding hours."""
    mine = lambda df, key="issue_key": df.join(F.broadcast(found.select(F.col("issue_key").alias(key))), key, "left_semi")
    logs = mine(tables["issue_worklogs"]).groupBy("issue_key").agg(F.sum("time_spent_seconds").alias("worklog_seconds"), F.min("author").alias("worklog_author"))
    commits = commit_rollup(mine(tables["commit_issue_refs"]), tables["commits"], tables["commit_files"])
    commits = commits.withColumnRenamed("authors", "commit_authors").drop("additions", "deletions")
    bugs = related_bugs(tables["issues"], tables["issue_links"], found.select("issue_key")).groupBy(F.col("parent").alias("issue_key")).agg(F.count("*").alias("bugs"))
    first = real_developers(mine(tables["issue_changelogs"])).withColumnRenamed("to_value", "first_assignee")
    rows = reduce(lambda a, b: a.join(b, "issue_key", "left"), (logs, commits, bugs, first), found)
    hours = lambda a, b: seconds_between(F.col(a), F.col(b)) / 3600
    return rows.withColumns({"cycle_hours": hours("created", "resolved"), "coding_hours": hours("first_commit", "last_commit")})


def estimate(tables: dict[str, DataFrame], description: str, assignee: str, asof: str, issue_type: str | None = None,
             components: list[str] | None = None, exclude_key: str | None = None, limit: int = 10, stemmed: bool = False) -> dict[str, DataFrame]:
    """prediction (one row), tasks, profiles of their developers, familiarity and its factor, and the assignee's coefficients.

    tables holds issues, issue_links, issue_worklogs, issue_changelogs, commits, commit_files and commit_issue_refs.
    """
    issues, links = tables["issues"], tables["issue_links"]
    found = similar(issues, description, asof, issue_type, components, exclude_key, limit, stemmed)
    tasks = settled(measured(tables, found), "estimate-tasks")
    chosen = with_fallback(coefficients(issues, links, [issue_type] if issue_type else None), coefficients(issues, links))
    hours = task_hours(tasks).select(F.lit(1).alias("request"), "hours", F.col("temporal_weight").alias("weight"), "cycle_only")
    request = issues.sparkSession.range(1).select(F.lit(1).alias("request"))
    known = familiarity(issues, assignee)
    return {"prediction": predictions(request, hours, chosen, assignee, ["request"]).drop("request"), "tasks": tasks,
            "profiles": profiles(tasks), "familiarity": known, "familiarity_factor": familiarity_factor(known, components or []),
            "coefficients": chosen.filter(has("assignee", assignee))}
