"""Project tables as views of the test tables.

The text of each view is plain SQL that Spark and the checking engine both
read, so one definition feeds an operator and the SQL that it is checked by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "concat('PRJ', {0} % 7, '-', {0})"

# events are of one month; pull requests are spread over the years of the orders, so that they meet issues
MERGED = "(ts - (event_id % 2400) * INTERVAL '1' DAY - INTERVAL '8200' DAY)"

VIEWS = {
    "issues": ("orders", f"""
        SELECT {ISSUE.format('o_orderkey')} AS issue_key, concat('PRJ', o_orderkey % 7) AS project_key,
            concat(o_orderpriority, ' order') AS summary, concat('Customer ', o_custkey, ' asks for ', o_orderstatus) AS description,
            CASE o_orderkey % 5 WHEN 0 THEN 'Bug' WHEN 1 THEN 'Story' WHEN 2 THEN 'Task' WHEN 3 THEN 'Sub-bug' ELSE 'Epic' END AS issue_type,
            o_orderstatus AS status, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'To Do' ELSE 'In Progress' END AS status_category,
            CASE WHEN o_custkey % 40 > 0 THEN concat('dev', o_custkey % 40) END AS assignee, concat('dev', o_orderkey % 25) AS reporter,
            CASE WHEN o_orderkey % 3 = 0 THEN concat('PRJ', CAST(floor(o_orderkey / 4) AS BIGINT) % 7, '-', CAST(floor(o_orderkey / 4) AS BIGINT)) END AS parent_key,
            CAST(floor(o_totalprice) AS BIGINT) % 90000 AS time_spent, 3600 * (1 + o_orderkey % 24) AS original_estimate,
            concat('c', o_custkey % 6, ',c', o_orderkey % 9) AS component_list,
            CASE WHEN o_orderkey % 4 > 0 THEN concat('l', o_custkey % 3, ',l', o_orderkey % 5) END AS label_list,
            o_orderdate AS created, o_orderdate AS updated,
            CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '5' DAY END AS resolved
        FROM orders"""),
    "commits": ("orders", """
        SELECT concat('h', o_orderkey) AS hash, concat('Fix PRJ', o_orderkey % 7, '-', o_orderkey, ' and PRJ1-00', o_custkey % 50) AS message,
            concat('dev', o_custkey % 40) AS author, o_orderdate AS committed_at, concat('repo', o_custkey % 3) AS repo_path
        FROM orders"""),
    "commit_files": ("lineitem", """
        SELECT concat('h', l_orderkey) AS commit_hash, concat('src/m', l_partkey % 30, '/f', l_partkey % 200, '.py') AS file_path,
            'modified' AS status, CAST(floor(l_quantity) AS BIGINT) AS additions, CAST(l_linenumber AS BIGINT) AS deletions
        FROM lineitem"""),
    "commit_issue_refs": ("orders", f"""
        SELECT concat('h', o_orderkey) AS commit_hash, {ISSUE.format('o_orderkey')} AS issue_key FROM orders
        UNION SELECT concat('h', o_orderkey), concat('PRJ1-', o_custkey % 50) FROM orders"""),
    "pull_requests": ("events", f"""
        SELECT event_id AS number, concat('org/r', user_id % 3) AS repo_full_name, concat(event_type, ' by ', user_id) AS title,
            concat('Implements PRJ', event_id % 7, '-', event_id) AS body,
            CASE event_type WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'closed' ELSE 'open' END AS state,
            concat('dev', user_id % 40) AS author, {MERGED} AS created_at, {MERGED} AS updated_at,
            CASE WHEN event_type = 'purchase' THEN {MERGED} END AS merged_at, 'main' AS base_ref
        FROM events"""),
    "pr_issue_refs": ("events", f"""
        SELECT concat('org/r', user_id % 3) AS repo_full_name, event_id AS pr_number, {ISSUE.format('event_id')} AS issue_key FROM events"""),
    "pr_reviews": ("events", """
        SELECT concat('org/r', user_id % 3) AS repo_full_name, event_id AS pr_number, concat('dev', (user_id + 1) % 40) AS reviewer,
            CASE WHEN event_id % 2 = 0 THEN 'APPROVED' ELSE 'COMMENTED' END AS state, ts AS submitted_at
        FROM events WHERE event_type <> 'view'"""),
    "issue_changelogs": ("lineitem", f"""
        SELECT {ISSUE.format('l_orderkey')} AS issue_key, CASE l_linenumber % 3 WHEN 0 THEN 'assignee' ELSE 'status' END AS field,
            CASE WHEN l_linenumber % 3 = 0 THEN concat('dev', l_suppkey % 40) WHEN l_returnflag = 'R' THEN 'Reopened' ELSE 'Open' END AS to_value,
            l_shipdate AS changed_at
        FROM lineitem"""),
    "issue_worklogs": ("lineitem", f"""
        SELECT {ISSUE.format('l_orderkey')} AS issue_key, concat('dev', l_suppkey % 20) AS author, CAST(floor(l_quantity) AS BIGINT) * 60 AS time_spent_seconds
        FROM lineitem"""),
    "issue_links": ("lineitem", f"""
        SELECT {ISSUE.format('l_orderkey')} AS source_key, {ISSUE.format('l_partkey')} AS target_key,
            CASE l_suppkey % 4 WHEN 0 THEN 'Blocks' WHEN 1 THEN 'Causes' WHEN 2 THEN 'is caused by' ELSE 'Related' END AS link_type
        FROM lineitem WHERE l_linenumber = 1"""),
    "db_tables": ("nation", """
        SELECT 'main' AS source_name, concat('s', n_regionkey) AS schema_name, n_name AS table_name,
            CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey * 1000 AS BIGINT) END AS row_count FROM nation"""),
    "db_columns": ("nation", "SELECT 'main' AS source_name, n_name AS table_name, concat('k', n_nationkey) AS column_name FROM nation"),
    "db_foreign_keys": ("supplier", """
        SELECT DISTINCT 'main' AS source_name, concat('t', s_nationkey) AS table_name, 's_nationkey' AS column_name, 'nation' AS referenced_table,
            'n_nationkey' AS referenced_column FROM supplier"""),
    "db_indexes": ("region", "SELECT 'main' AS source_name, r_name AS table_name, concat('i', r_regionkey) AS index_name FROM region"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A project table; components and labels come as arrays."""
    source, text = VIEWS[name]
    found = spark.sql(text.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: spark.read.parquet(f"{sf_dir}/{source}.parquet")})
    if name != "issues":
        return found
    return found.withColumns({"components": F.split("component_list", ","), "labels": F.split("label_list", ",")})


def with_views(query: str) -> str:
    """query after definitions of the views that it names."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", query)]
    views = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in used)
    query = query.strip()
    if not views:
        return query
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views}, {query[len('WITH RECURSIVE'):]}"
    return f"WITH {views}, {query[4:]}" if query.upper().startswith("WITH") else f"WITH {views} {query}"
