"""Every registered query, with the SQL that a second engine checks it with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import rendering, text
from spindrift.operators import board, estimate, graph, graph_store, lookup, postings, search, stats, store, vectors
from spindrift.plans.domain import table, with_views
from spindrift.session import settled, settled_parts, shared_folder
from spindrift.sources import catalog, code, dumps, proxy

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    """Project tables, and the test tables as they are, of one folder."""

    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f
    return add


@query("""WITH c AS (
    SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM issues
    UNION ALL SELECT 'status', status, count(*) FROM issues GROUP BY 2 UNION ALL SELECT 'issue_type', issue_type, count(*) FROM issues GROUP BY 2
    UNION ALL SELECT 'project_key', project_key, count(*) FROM issues GROUP BY 2
    UNION ALL (SELECT 'assignee', assignee, count(*) AS n FROM issues GROUP BY 2 ORDER BY n DESC, assignee NULLS LAST LIMIT 15)) SELECT * FROM c""")
def multi_group_stats(t):
    return stats.issue_stats(t.issues)


ISSUE_COLUMNS = "issue_key, project_key, summary, issue_type, status, assignee, updated"


@query(f"""SELECT {ISSUE_COLUMNS} FROM issues WHERE project_key = 'PRJ3' AND status ILIKE 'f' AND assignee ILIKE '%dev1%'
    ORDER BY updated DESC NULLS LAST, issue_key LIMIT 50""")
def filter_search_topk(t):
    return search.query_issues(t.issues, project="prj3", status="f", assignee="DEV1")


@query(f"""SELECT {ISSUE_COLUMNS} FROM issues WHERE summary ILIKE '%ustomer 12%' OR description ILIKE '%ustomer 12%'
    ORDER BY updated DESC NULLS LAST, issue_key LIMIT 50""")
def search_fallback_ilike(t):
    return search.query_issues(t.issues, search="ustomer 12")


@query(f"""SELECT {ISSUE_COLUMNS} FROM issues WHERE list_has_all(string_split_regex(lower(summary || ' ' || description), '[^a-z0-9]+'), ['urgent', 'customer'])
    ORDER BY updated DESC NULLS LAST, issue_key LIMIT 50""")
def issue_text_search(t):
    return search.query_issues(t.issues, search="the URGENT customer")


@query(f"""SELECT {ISSUE_COLUMNS} FROM (SELECT *, string_split_regex(lower(summary || ' ' || description), '[^a-z0-9]+') AS w FROM issues)
    WHERE list_has_any(w, ['urgent']) AND list_has_any(w, ['order', 'orders', 'ordered']) AND list_has_any(w, ['ask', 'asks', 'asked'])
    ORDER BY updated DESC NULLS LAST, issue_key LIMIT 50""")
def stemmed_search(t):
    return search.query_issues(t.issues, search="urgent orders asked", stemmed=True)


@query("""SELECT commit_hash, file_path, status, additions, deletions FROM commit_files WHERE commit_hash NOT IN (SELECT hash FROM commits WHERE author = 'dev3')
    UNION ALL SELECT hash, 'all.py', 'added', 1, 0 FROM commits WHERE author = 'dev3'""")
def saved_commit_files(t):
    old = {n: getattr(t, n) for n in ("commits", "commit_files", "commit_issue_refs")}
    mine = t.commits.filter("author = 'dev3'")
    files = mine.select(F.col("hash").alias("commit_hash"), F.lit("all.py").alias("file_path"), F.lit("added").alias("status"),
                        F.lit(1).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"))
    return store.save_batch("commits", old, {"commits": mine, "commit_files": files})["commit_files"]


@query("""SELECT 'db' AS source_name, concat('t', l_suppkey % 5) AS table_name, concat('i', l_partkey % 10) AS index_name,
        string_agg(concat('c', l_linenumber), ',' ORDER BY l_orderkey * 10 + l_linenumber) AS column_list,
        arg_min(l_tax > 0.04, l_orderkey * 10 + l_linenumber) AS is_unique, arg_min(l_discount > 0.05, l_orderkey * 10 + l_linenumber) AS is_primary
    FROM lineitem GROUP BY ALL""")
def folded_indexes(t):
    rows = t.raw("lineitem").selectExpr("concat('t', l_suppkey % 5) table_name", "concat('i', l_partkey % 10) index_name", "concat('c', l_linenumber) column_name",
                                        "l_tax > 0.04 is_unique", "l_discount > 0.05 is_primary", "l_orderkey * 10 + l_linenumber position")
    return catalog.indexes(rows, "db").withColumn("column_list", F.array_join("columns", ",")).drop("columns")


@query("""SELECT 'org/r' AS repo_full_name, CAST(event_id % 90 AS INTEGER) AS pr_number, event_id AS review_id, concat('dev', user_id % 40) AS reviewer,
        event_type AS state, CASE WHEN event_id % 2 = 0 THEN 'fine' END AS body, CAST(NULL AS TIMESTAMP) AS submitted_at FROM events""")
def landed_reviews(t):
    doc = """to_json(named_struct('id', event_id, 'user', named_struct('login', concat('dev', user_id % 40)), 'state', event_type,
        'body', if(event_id % 2 = 0, 'fine', null), 'pull_request_url', concat('https://host/pulls/', event_id % 90))) doc"""
    return dumps.reviews(t.raw("events").selectExpr(doc), "org/r")


@query("""SELECT concat('P-', o_orderkey) AS issue_key, 'P' AS project_key, concat('s', o_custkey) AS summary, o_orderstatus AS status,
        concat('c', o_custkey % 6, ',c', o_custkey % 4) AS component_list, CAST(o_custkey % 9 AS DOUBLE) AS story_points FROM orders""")
def proxied_issues(t):
    doc = """to_json(named_struct('key', concat('P-', o_orderkey), 'fields', named_struct('summary', concat('s', o_custkey), 'status', named_struct('name', o_orderstatus),
        'story_points', o_custkey % 9, 'components', array(named_struct('name', concat('c', o_custkey % 6)), named_struct('name', concat('c', o_custkey % 4)))))) doc"""
    found = proxy.issues(t.raw("orders").selectExpr(doc)).withColumn("component_list", F.array_join("components", ","))
    return found.select("issue_key", "project_key", "summary", "status", "component_list", "story_points")


@query("""SELECT doc_id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^a-z0-9]+'), ['thing', 'tion'])""")
def fts_and_match(t):
    return t.raw("documents").filter(text.matches(F.col("text"), "thing tion")).select("doc_id")


@query("""SELECT hash, message, author, committed_at, repo_path FROM commits WHERE author ILIKE '%dev1%' AND committed_at >= TIMESTAMP '1995-01-01'
    AND committed_at <= TIMESTAMP '2030-01-01' AND hash IN (SELECT commit_hash FROM commit_files WHERE file_path ILIKE '%m7/%')
    ORDER BY committed_at DESC NULLS LAST, hash LIMIT 50""")
def semi_join_file_filter(t):
    return search.query_commits(t.commits, t.commit_files, author="dev1", since="1995-01-01", until="2030-01-01", file_path="m7/")


@query("""SELECT * FROM pull_requests WHERE state = 'merged' AND author ILIKE '%dev2%' AND base_ref = 'main' AND updated_at >= TIMESTAMP '2024-01-10'
    ORDER BY updated_at DESC NULLS LAST, repo_full_name, number LIMIT 50""")
def pr_filter_topk(t):
    return search.query_prs(t.pull_requests, state="Merged", author="dev2", base_ref="main", since="2024-01-10")


@query("""SELECT * FROM issue_changelogs WHERE issue_key = 'PRJ3-10' ORDER BY changed_at DESC NULLS LAST, field, to_value LIMIT 20""")
def entity_detail_recent(t):
    return lookup.latest(t.issue_changelogs, "issue_key", "PRJ3-10", "changed_at", 20, "field", "to_value")


@query("""SELECT hash, author, committed_at, count(file_path) AS files, CAST(sum(additions) AS BIGINT) AS additions
    FROM commits LEFT JOIN commit_files ON hash = commit_hash WHERE hash IN (SELECT commit_hash FROM commit_issue_refs WHERE issue_key = 'PRJ1-7') GROUP BY ALL""")
def cross_ref_join_rollup(t):
    rows = lookup.issue_commits(t.commits, t.commit_issue_refs, t.commit_files, "prj1-7")
    return rows.select("hash", "author", "committed_at", F.coalesce(F.size("files"), F.lit(0)).cast("long").alias("files"),
                       F.aggregate("files", F.lit(0).cast("long"), lambda s, f: s + f["additions"]).alias("additions"))


@query("""SELECT repo_full_name, pr_number, author, string_agg(reviewer || ' ' || r.state, ', ' ORDER BY submitted_at, reviewer, r.state) AS reviews
    FROM pull_requests p JOIN pr_issue_refs i USING (repo_full_name) LEFT JOIN pr_reviews r USING (repo_full_name, pr_number)
    WHERE p.number = i.pr_number AND issue_key = 'PRJ5-12' GROUP BY ALL""")
def pr_reviews_of_issue(t):
    rows = lookup.issue_prs(t.pull_requests, t.pr_issue_refs, t.pr_reviews, "PRJ5-12")
    said = F.transform("reviews", lambda r: F.concat_ws(" ", r["reviewer"], r["state"]))
    return rows.select("repo_full_name", "pr_number", "author", F.array_join(said, ", ").alias("reviews"))


@query("""SELECT issue_key, created AS at, 'created' AS kind, 0 AS kind_order, summary AS detail FROM issues WHERE created IS NOT NULL
    UNION ALL SELECT issue_key, changed_at, 'changed', 1, to_value FROM issue_changelogs WHERE changed_at IS NOT NULL
    UNION ALL SELECT issue_key, committed_at, 'commit', 2, message FROM commit_issue_refs JOIN commits ON hash = commit_hash
    UNION ALL SELECT issue_key, created_at, 'pr_opened', 3, title FROM pr_issue_refs i JOIN pull_requests p ON number = pr_number AND i.repo_full_name = p.repo_full_name
    UNION ALL SELECT issue_key, submitted_at, 'pr_reviewed', 4, reviewer FROM pr_issue_refs JOIN pr_reviews USING (repo_full_name, pr_number)
    UNION ALL SELECT issue_key, merged_at, 'pr_merged', 5, title FROM pr_issue_refs i JOIN pull_requests p ON number = pr_number AND i.repo_full_name = p.repo_full_name
        WHERE merged_at IS NOT NULL""")
def timeline_union(t):
    prs = t.pr_issue_refs.join(t.pull_requests.withColumnRenamed("number", "pr_number"), ["repo_full_name", "pr_number"])
    part = lambda df, at, detail: df.select("issue_key", F.col(at).alias("at"), F.col(detail).alias("detail"))
    commits = t.commits
    refs = t.commit_issue_refs
    return lookup.timeline({
        "created": part(t.issues, "created", "summary"), "changed": part(t.issue_changelogs, "changed_at", "to_value"),
        "commit": part(refs.join(commits, refs["commit_hash"] == commits["hash"]), "committed_at", "message"),
        "pr_opened": part(prs, "created_at", "title"), "pr_merged": part(prs, "merged_at", "title"),
        "pr_reviewed": part(t.pr_issue_refs.join(t.pr_reviews, ["repo_full_name", "pr_number"]), "submitted_at", "reviewer")})


@query("""SELECT 'total' AS facet, NULL AS value, count(*) AS n FROM commits
    UNION ALL (SELECT 'author', author, count(*) AS n FROM commits GROUP BY author ORDER BY n DESC, author LIMIT 15)
    UNION ALL (SELECT 'file_path', file_path, count(*) AS n FROM commit_files GROUP BY file_path ORDER BY n DESC, file_path LIMIT 15)
    UNION ALL SELECT 'linked_issues', NULL, count(DISTINCT issue_key) FROM commit_issue_refs""")
def commit_stats_topn(t):
    return stats.commit_stats(t.commits, t.commit_files, t.commit_issue_refs)


@query("""SELECT 'tables' AS facet, NULL AS value, count(*) AS n, CAST(NULL AS BIGINT) AS row_count FROM db_tables
    UNION ALL SELECT 'columns', NULL, count(*), NULL FROM db_columns UNION ALL SELECT 'foreign_keys', NULL, count(*), NULL FROM db_foreign_keys
    UNION ALL SELECT 'indexes', NULL, count(*), NULL FROM db_indexes
    UNION ALL SELECT 'schema', schema_name, count(*), CAST(coalesce(sum(row_count), 0) AS BIGINT) FROM db_tables GROUP BY schema_name
    UNION ALL (SELECT 'largest', table_name, 1, coalesce(row_count, 0) AS r FROM db_tables ORDER BY r DESC, schema_name, table_name LIMIT 10)""")
def catalog_stats(t):
    return stats.db_stats(t.db_tables, t.db_columns, t.db_foreign_keys, t.db_indexes, "main")


def _query_vector(t) -> list[float]:
    return [float(x) for x in t.raw("embeddings").filter("vec_id = 7").first()["embedding"]]


COSINE = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 7))"


@query(f"SELECT vec_id, round({COSINE}, 5) AS similarity FROM embeddings ORDER BY {COSINE} DESC, vec_id LIMIT 20")
def cosine_topk(t):
    return vectors.semantic_search(t.raw("embeddings"), "vec_id", "embedding", _query_vector(t), 20).withColumn("similarity", F.round("similarity", 5))


@query(f"SELECT vec_id, round({COSINE}, 5) AS similarity FROM embeddings WHERE {COSINE} >= 0.2 ORDER BY {COSINE} DESC, vec_id LIMIT 1000")
def cosine_threshold(t):
    found = vectors.semantic_search(t.raw("embeddings"), "vec_id", "embedding", _query_vector(t), 1000, 0.2)
    return found.withColumn("similarity", F.round("similarity", 5))


def _covers(texts: str, *terms: str) -> str:
    """SQL for (key, score, hits) of texts (doc_id, text) with all terms: each word that ends a cover is the first that the cover's first word meets."""
    last = ", ".join(f"max(CASE WHEN term = '{t}' THEN pos END) OVER w AS l{i}, max(CASE WHEN term = '{t}' THEN place END) OVER w AS a{i}" for i, t in enumerate(terms))
    every = lambda c: ", ".join(f"{c}{i}" for i in range(len(terms)))
    return f"""SELECT key, round(sum(0.1::DOUBLE / (1 + others)), 9) AS score, any_value(hits) AS hits FROM (
        SELECT key, first, min(pos) AS last, arg_min((pos - first) - (place - first_place), pos) AS others, any_value(hits) AS hits FROM (
            SELECT *, least({every('l')}) AS first, least({every('a')}) AS first_place FROM (SELECT *, {last} FROM (
                SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS place, count(*) OVER (PARTITION BY key) / words AS hits FROM (
                    SELECT doc_id AS key, len(w) AS words, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
                        SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM ({texts})))
                WHERE term IN {terms}) WINDOW w AS (PARTITION BY key ORDER BY pos))
            WHERE {' AND '.join(f'l{i} IS NOT NULL' for i in range(len(terms)))})
        GROUP BY key, first) GROUP BY key"""


def _rounded_ranks(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query(_covers("SELECT doc_id, text FROM documents", "thing", "tion"))
def cover_density_search(t):
    return _rounded_ranks(postings.ranked_texts(t.raw("documents"), "doc_id", "text", "tion thing", stemmed=False))


CHANGED = "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE concat('thing and ', lang, ' tion') END AS text FROM documents"


@query(_covers(CHANGED, "thing", "tion"))
def indexed_search(t):
    """An index of the documents, refreshed by those in other languages than English, whose texts change."""
    index = postings.Index(t.spark, f"{shared_folder(t.spark)}/spindrift/index-{uuid.uuid4().hex}", buckets=16, stemmed=False)
    index.build(t.raw("documents"), "doc_id", "text")
    changed = t.raw("documents").filter("lang is null or lang <> 'en'")
    index.refresh(changed.select("doc_id", F.concat(F.lit("thing and "), "lang", F.lit(" tion")).alias("text")), "doc_id", "text")
    return _rounded_ranks(index.search("thing tion"))


@query(f"""WITH a AS (SELECT key AS id, row_number() OVER (ORDER BY s DESC, key) AS t FROM (SELECT key, score AS s FROM ({_covers("SELECT doc_id, text FROM documents", "thing", "tion")})
        ORDER BY s DESC, key LIMIT 20)),
    b AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS v FROM (SELECT vec_id AS id, {COSINE} AS s FROM embeddings WHERE {COSINE} >= 0.1 ORDER BY s DESC, id LIMIT 20))
    SELECT id, round(1.0::DOUBLE / (60 + coalesce(t, 1000)) + 1.0::DOUBLE / (60 + coalesce(v, 1000)), 9) AS score,
        CASE WHEN t IS NOT NULL AND v IS NOT NULL THEN 'both' WHEN t IS NOT NULL THEN 'text' ELSE 'semantic' END AS source
    FROM a FULL JOIN b USING (id) ORDER BY 1.0::DOUBLE / (60 + coalesce(t, 1000)) + 1.0::DOUBLE / (60 + coalesce(v, 1000)) DESC, id LIMIT 10""")
def rrf_hybrid(t):
    near = vectors.semantic_search(t.raw("embeddings").withColumnRenamed("vec_id", "id"), "id", "embedding", _query_vector(t), 20, 0.1)
    words = _rounded_ranks(postings.ranked_texts(t.raw("documents"), "doc_id", "text", "thing tion", stemmed=False)).withColumnRenamed("key", "id")
    return vectors.hybrid_search(words.select("id", "score"), near.withColumnRenamed("similarity", "score"), "id").withColumn("score", F.round("score", 9))


@query("""SELECT issue_key, to_value FROM issue_changelogs WHERE field = 'assignee' AND to_value <> ''
    QUALIFY row_number() OVER (PARTITION BY issue_key ORDER BY changed_at NULLS LAST, to_value) = 1""")
def distinct_on_first(t):
    return estimate.real_developers(t.issue_changelogs)


@query("SELECT issue_key, author, CAST(sum(time_spent_seconds) AS BIGINT) AS seconds FROM issue_worklogs GROUP BY ALL")
def worklog_sum(t):
    return estimate.worklog_sums(t.issue_worklogs)


@query("""WITH f AS (SELECT commit_hash, sum(additions) AS a, sum(deletions) AS d FROM commit_files GROUP BY 1)
    SELECT issue_key, count(*) AS commits, string_agg(DISTINCT author, ', ' ORDER BY author) AS authors, CAST(coalesce(sum(a), 0) AS BIGINT) AS additions,
        CAST(coalesce(sum(d), 0) AS BIGINT) AS deletions, min(committed_at) AS first_commit, max(committed_at) AS last_commit
    FROM commit_issue_refs r JOIN commits c ON c.hash = r.commit_hash LEFT JOIN f ON f.commit_hash = c.hash GROUP BY 1""")
def distinct_listagg(t):
    return estimate.commit_rollup(t.commit_issue_refs, t.commits, t.commit_files)


@query("""WITH k AS (SELECT issue_key FROM issues WHERE project_key = 'PRJ2')
    SELECT parent_key AS parent, issue_key FROM issues WHERE parent_key IN (SELECT * FROM k) AND issue_key NOT IN (SELECT * FROM k)
    UNION ALL SELECT source_key, target_key FROM issue_links WHERE source_key IN (SELECT * FROM k) AND target_key IN (SELECT issue_key FROM issues)
        AND target_key NOT IN (SELECT * FROM k)""")
def related_bug_rows(t):
    return estimate.related_bugs(t.issues, t.issue_links, t.issues.filter("project_key = 'PRJ2'").select("issue_key"))


COEFFICIENTS = """b AS (SELECT * FROM issues WHERE status_category = 'Done' AND original_estimate > 0 AND time_spent > 0
        AND issue_type NOT IN ('Bug', 'Sub-bug') AND time_spent / original_estimate < 5),
    g AS (SELECT * FROM issues WHERE issue_type IN ('Bug', 'Sub-bug') AND time_spent > 0),
    s AS (SELECT owner, sum(time_spent) AS bug_time FROM (SELECT parent_key AS owner, time_spent FROM g WHERE parent_key IS NOT NULL
        UNION ALL SELECT source_key, time_spent FROM (SELECT DISTINCT source_key, target_key, link_type FROM issue_links) JOIN g ON target_key = issue_key) GROUP BY 1),
    r AS (SELECT b.*, coalesce(bug_time, 0) AS bug_time FROM b LEFT JOIN s ON issue_key = owner)"""
COEFFICIENT_COLUMNS = """assignee, count(DISTINCT issue_key) AS tasks, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY time_spent / original_estimate), 6) AS coefficient,
    round(percentile_cont(0.5) WITHIN GROUP (ORDER BY (time_spent + bug_time) / original_estimate), 6) AS coefficient_with_bugs,
    round(avg(bug_time / time_spent), 6) AS bug_ratio"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("coefficient", "coefficient_with_bugs", "bug_ratio")})


@query(f"WITH {COEFFICIENTS} SELECT {COEFFICIENT_COLUMNS} FROM r GROUP BY assignee HAVING count(DISTINCT issue_key) >= 3")
def dev_coefficients(t):
    return _rounded(estimate.coefficients(t.issues, t.issue_links))


@query(f"""WITH {COEFFICIENTS}, c AS (SELECT {COEFFICIENT_COLUMNS} FROM r WHERE issue_type = 'Epic' AND assignee IS NOT NULL GROUP BY assignee HAVING count(DISTINCT issue_key) >= 5),
    a AS (SELECT {COEFFICIENT_COLUMNS} FROM r GROUP BY assignee HAVING count(DISTINCT issue_key) >= 3)
    SELECT *, 'context' AS source FROM c UNION ALL SELECT *, 'general' FROM a WHERE assignee NOT IN (SELECT assignee FROM c)""")
def coefficients_with_fallback(t):
    context = estimate.coefficients(t.issues.filter("assignee is not null or issue_type in ('Bug', 'Sub-bug')"), t.issue_links, ["Epic"], 5)
    return _rounded(estimate.with_fallback(context, estimate.coefficients(t.issues, t.issue_links)))


@query("""WITH h AS (SELECT project_key, time_spent / 3600.0::DOUBLE AS hours, CAST(1 + length(assignee) AS DOUBLE) / 10 AS weight FROM issues WHERE assignee IS NOT NULL),
    p AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY hours, weight) AS place, count(*) OVER (PARTITION BY project_key) AS n FROM h)
    SELECT project_key, max(n) AS tasks, round(sum(hours * weight) / sum(weight), 6) AS base_hours FROM p
    WHERE place > greatest(1, floor(n * 0.1)) AND place <= n - greatest(1, floor(n * 0.1)) GROUP BY 1""")
def trimmed_weighted_mean(t):
    tasks = t.issues.filter("assignee is not null").select("project_key", (F.col("time_spent") / 3600.0).alias("hours"),
                                                            ((1 + F.length("assignee")).cast("double") / 10).alias("weight"))
    return estimate.base_hours(tasks, ["project_key"]).withColumn("base_hours", F.round("base_hours", 6))


@query(f"""WITH {COEFFICIENTS}, c AS (SELECT {COEFFICIENT_COLUMNS} FROM r WHERE assignee IS NOT NULL GROUP BY assignee HAVING count(DISTINCT issue_key) >= 3 AND assignee ILIKE '%dev1%'
        ORDER BY assignee LIMIT 1),
    h AS (SELECT project_key, project_key = 'PRJ0' AS cycle_only, CASE project_key WHEN 'PRJ0' THEN 8.0::DOUBLE * len(list_filter(generate_series(CAST(created AS DATE),
            CAST(resolved AS DATE), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) WHEN 'PRJ1' THEN NULL ELSE coalesce(nullif(time_spent / 3600.0::DOUBLE, 0), original_estimate / 3600.0::DOUBLE) END AS hours,
        CAST(1 + length(reporter) AS DOUBLE) / 10 AS weight FROM issues),
    p AS (SELECT *, row_number() OVER (PARTITION BY project_key ORDER BY hours, weight) AS place, count(*) OVER (PARTITION BY project_key) AS n FROM h WHERE hours > 0),
    m AS (SELECT project_key, max(n) AS tasks, bool_and(cycle_only) AS cycle, round(min(hours) / 8) AS least, round(max(hours) / 8) AS most, sum(hours * weight) FILTER (kept) / sum(weight) FILTER (kept) AS base
        FROM (SELECT *, place > greatest(1, floor(n * 0.1)) AND place <= n - greatest(1, floor(n * 0.1)) AS kept FROM p) GROUP BY 1)
    SELECT project_key, CASE WHEN tasks IS NULL THEN 'none' WHEN cycle THEN 'range' ELSE 'predicted' END AS mode, coalesce(tasks, 0) AS tasks, CASE WHEN NOT cycle THEN round(base, 5) END AS base_hours,
        CAST(CASE WHEN cycle THEN least END AS BIGINT) AS least_days, CAST(CASE WHEN cycle THEN most END AS BIGINT) AS most_days,
        CASE WHEN NOT cycle THEN round(coefficient, 5) END AS coefficient, CASE WHEN NOT cycle THEN 'general' END AS coefficient_source,
        CASE WHEN NOT cycle THEN round(base * coefficient, 3) END AS predicted_hours, CASE WHEN NOT cycle THEN round(base * coefficient_with_bugs, 3) END AS predicted_hours_with_bugs
    FROM (SELECT DISTINCT project_key FROM issues) LEFT JOIN m USING (project_key), (SELECT coefficient, coefficient_with_bugs FROM c)""")
def estimate_modes(t):
    """One outcome for each project: PRJ0 is known by cycle times only, PRJ1 not at all."""
    none = lambda c, *keys: F.when(~F.col("project_key").isin(*keys), F.col(c)).alias(c)
    rows = t.issues.select("project_key", none("time_spent", "PRJ0", "PRJ1"), none("original_estimate", "PRJ0", "PRJ1"), none("created", "PRJ1"), none("resolved", "PRJ1"),
                           F.lit(None).cast("long").alias("worklog_seconds"), F.lit(None).cast("timestamp_ntz").alias("first_commit"),
                           F.lit(None).cast("timestamp_ntz").alias("last_commit"), ((1 + F.length("reporter")).cast("double") / 10).alias("weight"))
    chosen = estimate.coefficients(t.issues, t.issue_links).filter("assignee is not null").withColumn("source", F.lit("general"))
    found = estimate.predictions(t.issues.select("project_key"), estimate.task_hours(rows), _rounded(chosen), "dev1", ["project_key"])
    return found.select("project_key", "mode", "tasks", F.round("base_hours", 5).alias("base_hours"), "least_days", "most_days", F.round("coefficient", 5).alias("coefficient"), "coefficient_source",
                        F.round("predicted_hours", 3).alias("predicted_hours"), F.round("predicted_hours_with_bugs", 3).alias("predicted_hours_with_bugs"))


@query("""SELECT l_orderkey, l_linenumber, CAST(CASE WHEN CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) THEN 0 ELSE 8 * len(list_filter(
        generate_series(CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE), INTERVAL 1 DAY), lambda d: isodow(d) < 6)) END AS BIGINT) AS hours
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def business_hours(t):
    rows = t.raw("lineitem").join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", rendering.business_hours(F.col("o_orderdate"), F.col("l_shipdate")).alias("hours"))


@query("""SELECT component, count(DISTINCT issue_key) AS resolved_count, round(avg(time_spent) / 3600, 6) AS avg_time_hours, max(resolved) AS last_resolved
    FROM (SELECT issue_key, time_spent, resolved, unnest(string_split(component_list, ',')) AS component FROM issues
        WHERE assignee ILIKE '%dev1%' AND status_category = 'Done' AND time_spent > 0) GROUP BY 1""")
def component_familiarity(t):
    return estimate.familiarity(t.issues, "dev1").withColumn("avg_time_hours", F.round("avg_time_hours", 6))


@query("""WITH s AS (SELECT issue_key, CASE WHEN issue_type = 'Story' THEN 1.0::DOUBLE ELSE 0.0 END AS type_match,
        (CAST(list_contains(string_split(component_list, ','), 'c1') AS INT) + CAST(list_contains(string_split(component_list, ','), 'c2') AS INT)) / 2 AS component_overlap,
        1 / (1 + epoch(TIMESTAMP '2025-01-01' - coalesce(resolved, updated)) / (86400.0::DOUBLE * 365)) AS temporal_weight FROM issues WHERE status_category = 'Done')
    SELECT issue_key, round(0.25 * type_match + 0.35 * component_overlap + 0.1 * temporal_weight, 6) AS composite_score FROM s""")
def composite_score(t):
    rows = estimate.scored(t.issues.filter("status_category = 'Done'"), F.lit(0.0), "2025-01-01", "Story", ["c1", "c2"])
    return rows.select("issue_key", F.round("composite_score", 6).alias("composite_score"))


@query("""SELECT a.file_path AS first, b.file_path AS second, count(*) AS n FROM commit_files a JOIN commit_files b
    ON a.commit_hash = b.commit_hash AND a.file_path < b.file_path GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, 1, 2 LIMIT 500""")
def co_change_pairs(t):
    return graph.co_changes(t.commit_files)


@query("""SELECT u.event_id AS probe, p.event_id AS event_id, row_number() OVER (PARTITION BY u.event_id ORDER BY p.ts DESC, p.event_id) AS place
    FROM events u JOIN events p ON p.ts < u.ts AND p.ts > u.ts - INTERVAL 14 DAY WHERE u.event_type = 'signup' AND p.event_type = 'purchase' QUALIFY place <= 5""")
def range_join_suspects(t):
    e = t.raw("events")
    probes = e.filter("event_type = 'signup'").select(F.col("event_id").alias("probe"), F.col("ts").alias("at"))
    found = graph.within_days(probes, e.filter("event_type = 'purchase'").select("event_id", F.col("ts").alias("event_at")), ties=("event_id",))
    return found.select("probe", "event_id", F.col("place").cast("long").alias("place"))


ALL_REOPENED = """SELECT pr AS source, issue_key AS target FROM (SELECT DISTINCT issue_key, changed_at FROM issue_changelogs WHERE field = 'status' AND to_value = 'Reopened')
        JOIN (SELECT concat(repo_full_name, '#', number) AS pr, merged_at FROM pull_requests WHERE merged_at IS NOT NULL)
        ON merged_at < changed_at AND merged_at > changed_at - INTERVAL 14 DAY"""
REOPENED = f"""{ALL_REOPENED}
        QUALIFY row_number() OVER (PARTITION BY issue_key, changed_at ORDER BY merged_at DESC, pr) <= 5"""
ASOF = "2001-08-01"
BUG_CAUSES = """SELECT pr AS source, bug AS target FROM (SELECT DISTINCT bug, pr, merged_at FROM (SELECT issue_key AS bug, created, unnest(string_split(component_list, ',')) AS component
            FROM issues WHERE issue_type IN ('Bug', 'Defect') AND created >= TIMESTAMP '2001-02-01')
        JOIN (SELECT concat(r.repo_full_name, '#', pr_number) AS pr, merged_at, unnest(string_split(component_list, ',')) AS component FROM pr_issue_refs r
            JOIN issues USING (issue_key) JOIN pull_requests p ON r.repo_full_name = p.repo_full_name AND pr_number = number WHERE merged_at IS NOT NULL) USING (component)
        WHERE merged_at < created AND merged_at > created - INTERVAL 14 DAY)
        QUALIFY row_number() OVER (PARTITION BY bug ORDER BY merged_at DESC, pr) <= 5"""
PLAIN_EDGES = f"""SELECT issue_key AS source, 'issue' AS source_type, 'assigned_to' AS type, assignee AS target, 'developer' AS target_type, 1.0::DOUBLE AS weight
        FROM issues WHERE assignee IS NOT NULL
    UNION ALL SELECT issue_key, 'issue', 'reported_by', reporter, 'developer', 1 FROM issues
    UNION ALL SELECT DISTINCT issue_key, 'issue', 'labeled', unnest(string_split(label_list, ',')), 'label', 1 FROM issues
    UNION ALL SELECT DISTINCT issue_key, 'issue', 'in_component', unnest(string_split(component_list, ',')), 'component', 1 FROM issues
    UNION ALL SELECT parent_key, 'issue', 'parent_of', issue_key, 'issue', 1 FROM issues WHERE parent_key IS NOT NULL
    UNION ALL SELECT DISTINCT author, 'developer', 'authored_commit_for', issue_key, 'issue', 1 FROM commits JOIN commit_issue_refs ON hash = commit_hash
    UNION ALL SELECT author, 'developer', 'changed', 'src/' || split_part(file_path, '/', 2), 'module', count(*) FROM commits JOIN commit_files ON hash = commit_hash GROUP BY ALL
    UNION ALL SELECT DISTINCT concat(repo_full_name, '#', pr_number), 'pull_request', 'implements', issue_key, 'issue', 1 FROM pr_issue_refs
    UNION ALL SELECT DISTINCT author, 'developer', 'authored_pr', concat(repo_full_name, '#', number), 'pull_request', 1 FROM pull_requests
    UNION ALL SELECT DISTINCT reviewer, 'developer', 'reviewed', concat(repo_full_name, '#', pr_number), 'pull_request', 1 FROM pr_reviews
    UNION ALL SELECT DISTINCT source_key, 'issue', CASE WHEN link_type = 'Blocks' THEN 'blocked_by' ELSE 'root_causes' END, target_key, 'issue', 1
        FROM issue_links WHERE link_type <> 'Related'
    UNION ALL SELECT a, 'module', 'co_changes', b, 'module', min(n) FROM (SELECT 'src/' || split_part(first, '/', 2) AS a, 'src/' || split_part(second, '/', 2) AS b, n
        FROM (SELECT f.file_path AS first, g.file_path AS second, count(*) AS n FROM commit_files f JOIN commit_files g
            ON f.commit_hash = g.commit_hash AND f.file_path < g.file_path GROUP BY 1, 2 HAVING count(*) >= 3 ORDER BY n DESC, 1, 2 LIMIT 500)) WHERE a <> b GROUP BY ALL
    UNION ALL SELECT source, 'pull_request', 'probably_caused_by', target, 'issue', 1 FROM (({REOPENED}) UNION ({BUG_CAUSES}))"""
ALL_EDGES = f"""SELECT *, CASE WHEN type IN ('blocked_by', 'root_causes', 'probably_caused_by') THEN 'auto' ELSE 'structural' END AS origin FROM ({PLAIN_EDGES})"""
WALK = """WITH RECURSIVE e AS MATERIALIZED (%s), u AS MATERIALIZED (SELECT source, source_type, target, target_type FROM e UNION SELECT target, target_type, source, source_type FROM e),
    w AS (SELECT DISTINCT source AS name, source_type AS type, 0 AS depth FROM u WHERE source ILIKE '%%m7%%'
        UNION SELECT target, target_type, depth + 1 FROM w JOIN u ON name = source AND type = source_type WHERE depth < %d),
    n AS MATERIALIZED (SELECT name, type, min(depth) AS depth FROM w GROUP BY 1, 2 ORDER BY 3, 2, 1 LIMIT 200),
    b AS MATERIALIZED (SELECT e.* FROM e WHERE (source, source_type) IN (SELECT (name, type) FROM n) OR (target, target_type) IN (SELECT (name, type) FROM n))"""
BUSIEST = """SELECT name, count(*) AS total, CAST(count_if(type IN ('authored_commit_for', 'changed')) AS BIGINT) AS commits, CAST(count_if(type = 'reviewed') AS BIGINT) AS reviews,
    CAST(count_if(type = 'assigned_to') AS BIGINT) AS assigned FROM (SELECT source AS name, type FROM {0} WHERE source_type = 'developer'
        UNION ALL SELECT target, type FROM {0} WHERE target_type = 'developer') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
GRAPH_TABLES = ("issues", "commits", "commit_issue_refs", "commit_files", "pull_requests", "pr_issue_refs", "pr_reviews", "issue_links", "issue_changelogs")


def _tables(t) -> dict[str, DataFrame]:
    return {n: getattr(t, n) for n in GRAPH_TABLES}


def _graph(t) -> DataFrame:
    return graph.build(_tables(t), ASOF)


def _stored(t) -> DataFrame:
    return graph.stored(_tables(t), ASOF)


@query(ALL_EDGES)
def graph_build_edges(t):
    return _graph(t)


@query(WALK % (ALL_EDGES, 2) + " SELECT * FROM n")
def graph_walk(t):
    g = _stored(t)
    return graph.walk(g, graph.seeds(g, "m7"), 2)


@query(WALK % (ALL_EDGES, 2) + BUSIEST.format("b"))
def developer_expertise(t):
    return graph.expertise(_stored(t), "m7")


@query(WALK % (ALL_EDGES, 2) + """ SELECT name, count(*) AS edges FROM (SELECT source AS name FROM b WHERE source_type = 'developer'
    UNION ALL SELECT target FROM b WHERE target_type = 'developer') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def impact_developers(t):
    return graph.impact(_stored(t), "m7")["developers"]


IMPORTS = """SELECT DISTINCT concat('src/m', l_partkey % 30, '/f', l_partkey % 200, '.py') AS path,
        concat('src/m', l_suppkey % 30, '/f', l_suppkey % 400) || CASE WHEN concat('src/m', l_suppkey % 30, '/f', l_suppkey % 400, '.py') IN (
            SELECT concat('src/m', l_partkey % 30, '/f', l_partkey % 200, '.py') FROM lineitem) THEN '.py' ELSE '' END AS target FROM lineitem"""
PACKAGES = """SELECT DISTINCT concat('app', p_size % 5) AS project, concat('src/m', p_partkey % 40) AS package FROM part"""
CODE_EDGES = f"""{ALL_EDGES} UNION ALL SELECT DISTINCT 'src/' || split_part(path, '/', 2), 'module', 'imports', 'src/' || split_part(target, '/', 2), 'module', 1.0::DOUBLE, 'structural'
        FROM ({IMPORTS}) WHERE split_part(path, '/', 2) <> split_part(target, '/', 2)
    UNION ALL SELECT project, 'package', 'depends_on_pkg', package, 'package', 1, 'structural' FROM ({PACKAGES})"""


def _sources(t) -> DataFrame:
    """Source files of the test tables: a line for each import."""
    rows = t.raw("lineitem").selectExpr("concat('src/m', l_partkey % 30, '/f', l_partkey % 200, '.py') path",
                                        "concat('import x from \\'./../m', l_suppkey % 30, '/./f', l_suppkey % 400, '\\'') line")
    return rows.distinct().groupBy("path").agg(F.array_join(F.collect_list("line"), "\n").alias("value"))


def _manifests(t) -> DataFrame:
    named = F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("src/m"), F.col("p_partkey") % 40), F.lit("1")))))
    rows = t.raw("part").groupBy(F.concat(F.lit("app"), F.col("p_size") % 5).alias("name")).agg(named.alias("dependencies"))
    return rows.select(F.to_json(F.struct("name", "dependencies")).alias("doc"))


@query(f"SELECT path, target, target LIKE '%.py' AS resolved FROM ({IMPORTS})")
def resolved_imports(t):
    return code.imports(_sources(t)).select("path", "target", "resolved").distinct()


@query(WALK % (CODE_EDGES, 2) + """ SELECT * FROM b WHERE type IN ('co_changes', 'imports', 'depends_on_pkg')
    QUALIFY row_number() OVER (PARTITION BY type ORDER BY weight DESC, source, target) <= CASE type WHEN 'co_changes' THEN 15 ELSE 20 END""")
def code_dependencies(t):
    tables = _tables(t) | {"imports": code.imports(settled(_sources(t), "sources")), "packages": code.packages(_manifests(t))}
    return graph.dependencies(graph.stored(tables, ASOF), "m7")


@query(f"WITH e AS ({ALL_EDGES}) " + BUSIEST.format("e"))
def graph_degree_rank(t):
    return graph.busiest(_graph(t))


@query(f"""WITH e AS ({ALL_EDGES}) SELECT 'entity' AS facet, type AS value, count(*) AS n FROM (SELECT source AS name, source_type AS type FROM e
    UNION SELECT target, target_type FROM e) GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY 2""")
def graph_stats(t):
    return graph.stats(_stored(t))


BY_HAND = """SELECT concat('P', o_custkey) AS source, 'business_process' AS source_type, CASE WHEN o_orderkey % 2 = 0 THEN 'caused_by' ELSE 'root_causes' END AS type,
    concat('PRJ', o_orderkey % 7, '-', o_orderkey) AS target, 'issue' AS target_type, 1.0::DOUBLE AS weight FROM orders WHERE o_orderpriority = '1-URGENT'"""


def _by_hand(t) -> DataFrame:
    rows = t.raw("orders").filter("o_orderpriority = '1-URGENT'")
    kind = F.when(F.col("o_orderkey") % 2 == 0, "caused_by").otherwise("root_causes")
    return rows.select(F.concat(F.lit("P"), "o_custkey").alias("source"), F.lit("business_process").alias("source_type"), kind.alias("type"),
                       F.concat(F.lit("PRJ"), F.col("o_orderkey") % 7, F.lit("-"), "o_orderkey").alias("target"), F.lit("issue").alias("target_type"),
                       F.lit(1.0).alias("weight"), F.lit(graph.BY_HAND).alias("origin"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED ({ALL_EDGES} UNION ALL SELECT *, 'claude' FROM ({BY_HAND})),
    u AS MATERIALIZED (SELECT source, source_type, target, target_type FROM e UNION SELECT target, target_type, source, source_type FROM e),
    w AS (SELECT DISTINCT source AS name, source_type AS type, 0 AS depth FROM u WHERE source ILIKE '%prj3-10%'
        UNION SELECT target, target_type, depth + 1 FROM w JOIN u ON name = source AND type = source_type WHERE depth < 3)
    SELECT name, type, min(depth) AS depth, name IN (SELECT target FROM e WHERE origin = 'claude' AND target_type = 'issue') AS semantic
    FROM w WHERE type = 'issue' AND name <> 'PRJ3-10' GROUP BY 1, 2""")
def related_issues(t):
    g = graph_store.merge(_stored(t), settled(_by_hand(t), "by-hand"), unique=True)
    return graph.related_issues(g, "prj3-10", limit=None)


@query(f"""WITH g AS ({ALL_EDGES} UNION ALL SELECT *, 'claude' AS origin FROM ({BY_HAND}))
    SELECT source, source_type, type, target, CASE WHEN origin = 'claude' THEN 'manual' WHEN type = 'probably_caused_by' THEN 'probable' ELSE 'confirmed' END AS bucket
    FROM g WHERE target_type = 'issue' AND type IN ('root_causes', 'probably_caused_by', 'blocked_by', 'caused_by')""")
def root_cause_buckets(t):
    g = graph_store.merge(settled_parts(graph.causal_parts(_tables(t), ASOF), "causes"), _by_hand(t))
    return graph.causes(g).select("source", "source_type", "type", "target", "bucket")


@query(f"{ALL_EDGES} UNION ALL SELECT *, 'claude' FROM ({BY_HAND})")
def incremental_graph(t):
    """The graph of former issues with manual edges, brought up to date by what was updated since; equal to one built anew."""
    tables = _tables(t)
    now = F.col("updated") >= F.lit("1998-01-01").cast("timestamp_ntz")
    former = tables["issues"].withColumns({"assignee": F.when(now, "nobody").otherwise(F.col("assignee")), "labels": F.when(now, F.array(F.lit("old"))).otherwise(F.col("labels"))})
    first = graph_store.rebuilt(graph_store.empty(t.spark), tables | {"issues": former}, ASOF)
    held = graph_store.Graph(graph_store.merge(first.edges, _by_hand(t)), first.entities, first.observations)
    return graph_store.rebuilt(held, tables, ASOF, since="1998-01-01").edges


@query("""SELECT DISTINCT issue_key AS name, 'issue' AS type FROM issues WHERE issue_key NOT IN (SELECT source_key FROM issue_links WHERE link_type <> 'Related')
    AND issue_key NOT IN (SELECT target_key FROM issue_links WHERE link_type <> 'Related')""")
def orphan_entities(t):
    return graph.orphans(t.issues.select(F.col("issue_key").alias("name"), F.lit("issue").alias("type")), graph.link_edges(t.issue_links))


@query("""WITH r AS (SELECT DISTINCT issue_key, changed_at FROM issue_changelogs WHERE field = 'status' AND to_value = 'Reopened'),
    m AS (SELECT concat('h', o_orderkey) AS pr, o_orderdate AS merged_at FROM orders)
    SELECT issue_key AS source, pr AS target FROM r JOIN m ON merged_at < changed_at AND merged_at > changed_at - INTERVAL 14 DAY
    QUALIFY row_number() OVER (PARTITION BY issue_key, changed_at ORDER BY merged_at DESC, pr) <= 5""")
def regression_suspects(t):
    reopened = t.issue_changelogs.filter("field = 'status' and to_value = 'Reopened'").select(F.col("issue_key").alias("probe"), F.col("changed_at").alias("at")).distinct()
    merged = t.raw("orders").select(F.concat(F.lit("h"), "o_orderkey").alias("pr"), F.col("o_orderdate").alias("event_at"))
    return graph.within_days(reopened, merged, ties=("pr",)).select(F.col("probe").alias("source"), F.col("pr").alias("target"))


@query(f"""SELECT DISTINCT source, 'pull_request' AS source_type, 'probably_caused_by' AS type, target, 'issue' AS target_type FROM ({ALL_REOPENED})""")
def regression_edges(t):
    return graph.regressions(t.issue_changelogs, t.pull_requests).select("source", "source_type", "type", "target", "target_type")


@query(f"""SELECT source, 'pull_request' AS source_type, 'probably_caused_by' AS type, target, 'issue' AS target_type, 1.0::DOUBLE AS weight, 'auto' AS origin FROM ({BUG_CAUSES})""")
def bug_cause_edges(t):
    return graph.bug_causes(t.issues, t.pull_requests, t.pr_issue_refs, ASOF)


@query("SELECT commit_hash, issue_key FROM commit_issue_refs")
def issue_key_extract(t):
    from spindrift.sources.dumps import commit_refs

    return commit_refs(t.commits)


@query("""SELECT DISTINCT file_path, 'src/' || split_part(file_path, '/', 2) AS module FROM commit_files""")
def module_names(t):
    return t.commit_files.select("file_path").distinct().select("file_path", text.module_name(F.col("file_path")).alias("module"))


@query("""SELECT n_nationkey, CASE WHEN s < 1024 THEN s || 'B' WHEN s < 1048576 THEN CAST(floor(s / 1024 + 0.5) AS BIGINT) || 'KB'
    WHEN s < 1073741824 THEN CAST(floor(s / 1048576 + 0.5) AS BIGINT) || 'MB' ELSE CAST(floor(s / 1073741824 + 0.5) AS BIGINT) || 'GB' END AS size
    FROM (SELECT n_nationkey, CAST(n_nationkey AS BIGINT) * n_nationkey * n_nationkey * n_nationkey * n_nationkey * 300 AS s FROM nation)""")
def bytes_rendered(t):
    n = F.col("n_nationkey").cast("long")
    return t.raw("nation").select("n_nationkey", rendering.format_bytes(n * n * n * n * n * 300).alias("size"))


@query("""SELECT issue_key, status, assignee FROM issues WHERE NOT (created >= TIMESTAMP '1996-01-01' AND project_key = 'PRJ1')
    UNION ALL SELECT issue_key, 'Changed', assignee FROM issues WHERE created >= TIMESTAMP '1996-01-01' AND project_key = 'PRJ1'""")
def upsert_snapshot(t):
    old = t.issues.select("issue_key", "status", "assignee")
    new = t.issues.filter("created >= timestamp_ntz '1996-01-01' and project_key = 'PRJ1'").select("issue_key", F.lit("Changed").alias("status"), F.lit(None).cast("string").alias("assignee"))
    return store.upsert(old, new, ["issue_key"], keep=("assignee",))


@query("""SELECT issue_key, author, time_spent_seconds FROM issue_worklogs WHERE issue_key NOT IN (SELECT issue_key FROM issues WHERE project_key = 'PRJ4')
    UNION ALL SELECT issue_key, 'nobody', 60 FROM issues WHERE project_key = 'PRJ4'""")
def replaced_children(t):
    parents = t.issues.filter("project_key = 'PRJ4'").select("issue_key")
    return store.replace_children(t.issue_worklogs, parents.select("issue_key", F.lit("nobody").alias("author"), F.lit(60).cast("long").alias("time_spent_seconds")), parents, "issue_key")


@query("SELECT repo_full_name, max(updated_at) AS latest, max(updated_at) - INTERVAL 60 SECOND AS since FROM pull_requests GROUP BY 1")
def high_water_mark(t):
    return store.high_water(t.pull_requests, "repo_full_name", "updated_at")


@query("SELECT DISTINCT project_key FROM issues")
def project_list(t):
    return search.projects(t.issues)


CARDS = """SELECT concat('t', o_orderkey) AS md_path, concat('Task ', o_orderkey) AS title, CASE o_orderkey % 7 WHEN 0 THEN 'backlog' WHEN 1 THEN 'done' WHEN 2 THEN 'review' WHEN 3 THEN 'build'
        WHEN 4 THEN 'lost' END AS column_name, concat('PRJ-', o_orderkey) AS jira_key, concat('dev', o_custkey % 40) AS assignee, o_orderdate AS created_at,
        o_orderdate + INTERVAL '1' DAY AS updated_at, concat('e', o_custkey % 3) AS epic FROM orders"""
COLUMNS = [(1, "backlog", "system"), (2, "build", "skill"), (3, "review", "skill"), (4, "done", "system")]


def _cards(t) -> DataFrame:
    return t.spark.sql(CARDS.replace("FROM orders", "FROM {orders}"), orders=t.raw("orders"))


def _columns(t) -> DataFrame:
    return t.spark.createDataFrame(COLUMNS, "place long, name string, type string")


@query(f"SELECT * FROM ({CARDS}) WHERE column_name = 'review'")
def board_by_column(t):
    return board.by_column(_cards(t), "review")


@query(f"""WITH c AS ({CARDS}) SELECT md_path, title, column_name, jira_key, assignee, created_at, updated_at FROM c
    UNION ALL SELECT md_path, any_value(title), any_value(column_name), any_value(jira_key), any_value(assignee), TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01' FROM (
        SELECT concat('t', l_orderkey + l_linenumber * 3) AS md_path, concat('File ', l_orderkey + l_linenumber * 3) AS title, CASE (l_orderkey + l_linenumber * 3) % 4 WHEN 0 THEN 'review'
            WHEN 1 THEN 'done' ELSE 'backlog' END AS column_name, CAST(NULL AS VARCHAR) AS jira_key, 'me' AS assignee FROM lineitem WHERE (l_orderkey + l_linenumber * 3) % 5 > 0)
    WHERE md_path NOT IN (SELECT md_path FROM c) GROUP BY md_path""")
def board_synced(t):
    n = "(l_orderkey + l_linenumber * 3)"
    files = t.raw("lineitem").selectExpr(
        f"concat('t', {n}) md_path", f"concat('File ', {n}) title", f"case {n} % 4 when 0 then 'review' end named_column", "cast(null as string) jira_key", "'me' assignee",
        f"case when {n} % 5 = 0 then 'Other' when {n} % 4 = 1 then 'Done' when {n} % 4 = 2 then 'ToDo' else 'Backlog' end folder")
    return board.synced(_cards(t), files, "2025-01-01")


@query(f"""SELECT *, CASE WHEN column_name IN ('backlog', 'build', 'done') THEN column_name ELSE 'backlog' END AS shown_in FROM ({CARDS}) WHERE epic = 'e1'
    AND (column_name IS DISTINCT FROM 'done' OR updated_at >= TIMESTAMP '1998-08-02' - INTERVAL 90 DAY)""")
def board_visible(t):
    return board.shown(_cards(t), _columns(t), "1998-08-02", epic="e1", skills=["build"], done_value=3, done_unit="months")


@query("""WITH s AS (SELECT p_type AS name, min(p_partkey) AS place FROM part WHERE p_type NOT IN ('backlog', 'build', 'review', 'done') GROUP BY 1)
    SELECT place, name, type FROM (VALUES (1, 'backlog', 'system'), (2, 'build', 'skill'), (3, 'review', 'skill')) v(place, name, type)
    UNION ALL SELECT 3 + row_number() OVER (ORDER BY place, name), name, 'skill' FROM s UNION ALL SELECT 4 + count(*), 'done', 'system' FROM s""")
def board_pipeline(t):
    return board.pipeline(_columns(t), t.raw("part").select(F.col("p_partkey").alias("place"), F.col("p_type").alias("name")))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
