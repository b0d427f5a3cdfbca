"""What the graph's steps cost as tables grow: shuffles, rows of a file, and lookups by distinct times; and results where rows repeat."""

import datetime as dt

from spindrift.operators import graph, graph_store
from spindrift.session import FILE_ROWS, settled

DAY = dt.datetime(2020, 6, 1)
EDGE = "source string, source_type string, type string, target string, target_type string, weight double, origin string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_issue_edges_take_one_shuffle_and_repeat_none(spark):
    issue = "issue_key string, assignee string, reporter string, parent_key string, labels array<string>, components array<string>"
    issues = spark.createDataFrame([("A-1", "ann", "bob", None, ["l", "l", None], ["c"]), ("A-1", "ann", "eve", "A-0", ["m"], None), (None, "x", "y", "z", ["l"], ["c"])], issue)
    found = graph.issue_edges(issues)
    assert plan(found).count("Exchange hashpartitioning") == 1
    assert [r[:5:2] for r in rows(found.select("source", "source_type", "type", "target_type", "target"))] == [
        ("A-0", "parent_of", "A-1"), ("A-1", "assigned_to", "ann"), ("A-1", "in_component", "c"), ("A-1", "labeled", "l"), ("A-1", "labeled", "m"),
        ("A-1", "reported_by", "bob"), ("A-1", "reported_by", "eve")]


def test_probes_of_one_time_are_looked_up_once(spark):
    probes = spark.range(500).selectExpr("concat('p', id) probe", "timestamp_ntz '2020-06-01' at")
    events = spark.createDataFrame([(f"e{i}", DAY - dt.timedelta(days=i)) for i in range(1, 8)], "id string, event_at timestamp_ntz")
    found = graph.within_days(probes, events, ties=("id",))
    assert "_p#" not in plan(found)  # windows and ranks hold times, no probes
    got = rows(found.filter("probe = 'p7'").select("id", "place"))
    assert got == [("e1", 1), ("e2", 2), ("e3", 3), ("e4", 4), ("e5", 5)] and found.count() == 2500


def test_a_repeated_pull_request_crowds_out_no_other(spark):
    issues = spark.createDataFrame([("A-1", "Bug", ["c"], DAY), ("A-2", "Task", ["c"], DAY)], "issue_key string, issue_type string, components array<string>, created timestamp_ntz")
    merged = [("o/r", 1, DAY - dt.timedelta(days=1))] * 6 + [("o/r", 2, DAY - dt.timedelta(days=2))]
    prs = spark.createDataFrame(merged, "repo_full_name string, number long, merged_at timestamp_ntz")
    refs = spark.createDataFrame([("o/r", 1, "A-2"), ("o/r", 2, "A-2")], "repo_full_name string, pr_number long, issue_key string")
    assert [r.source for r in graph.bug_causes(issues, prs, refs, "2020-07-01").orderBy("source").collect()] == ["o/r#1", "o/r#2"]


def test_edges_of_other_kinds_merge_without_a_shuffle(spark):
    old = spark.createDataFrame([("a", "x", "t", "b", "y", 1.0, "claude")], EDGE)
    new = settled(spark.range(10).selectExpr("concat('a', id) source", "'x' source_type", "'u' type", "'b' target", "'y' target_type", "1.0D weight", "'auto' origin"))
    found = graph_store.merge(old, new, unique=True)
    assert "Exchange" not in plan(found) and found.count() == 11


def test_a_walk_over_a_stored_graph_shuffles_no_edges(spark):
    g = settled(spark.createDataFrame([(f"i{i}", "issue", "assigned_to", f"d{i % 3}", "developer", 1.0, "structural") for i in range(60)], EDGE))
    near = graph.walk(g, graph.seeds(g, "d1"), 1, None)
    assert "SortMergeJoin" not in plan(near) and near.count() == 21
    assert graph.edges_of(g, near).count() == 20 and "SortMergeJoin" not in plan(graph.edges_of(g, settled(near)))


def test_settled_files_hold_few_rows_and_shuffles_are_let_go(spark):
    found = settled(spark.range(FILE_ROWS * 2 + 10).coalesce(1))
    assert len(found.inputFiles()) == 3 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_issues_of_single_keys_are_not_shuffled(spark):
    issue = "issue_key string, assignee string, reporter string, parent_key string, labels array<string>, components array<string>"
    issues = spark.createDataFrame([(f"A-{i}", "ann", None, None if i % 2 else "A-0", ["l", "l", None], None) for i in range(20)] + [("A-7", "bob", None, None, ["l"], ["c"])], issue)
    found = graph.issue_edges(issues)
    assert plan(found).count("LeftAnti") == 5 and "SortMergeJoin" not in plan(found)
    assert found.count() == found.distinct().count() == 21 + 20 + 10 + 1  # assignees, labels, parents, component


def test_reopenings_of_few_times_are_not_shuffled(spark):
    changes = spark.range(50).selectExpr("concat('A-', id) issue_key", "'status' field", "'Reopened' to_value", "timestamp_ntz '2020-06-01' changed_at")
    prs = spark.createDataFrame([("o/r", i, DAY - dt.timedelta(days=i)) for i in range(1, 4)], "repo_full_name string, number long, merged_at timestamp_ntz")
    found = graph.before_reopenings(changes, prs)
    assert "Exchange hashpartitioning" not in plan(found) and found.count() == 50 and {len(r.prs) for r in found.collect()} == {3}


def test_paths_of_a_commit_are_paired_without_a_join(spark):
    files = spark.createDataFrame([("c1", "a"), ("c1", "b"), ("c1", "b"), ("c1", None), ("c2", "b"), ("c2", "a"), ("c2", "c"), (None, "a"), (None, "b")], "commit_hash string, file_path string")
    found = graph.co_changes(files, least=1)
    assert "Join" not in plan(found) and [tuple(r) for r in found.collect()] == [("a", "b", 3), ("a", "c", 1), ("b", "c", 1)]
    assert [tuple(r) for r in graph.co_changes(files, least=1, widest=3).collect()] == [("a", "b", 1), ("a", "c", 1), ("b", "c", 1)]


def test_a_walk_of_a_limit_makes_no_needless_steps(spark):
    g = settled(spark.range(3000).selectExpr("concat('i', id) source", "'issue' source_type", "'assigned_to' type", "concat('d', id % 3) target", "'developer' target_type", "1.0D weight",
                                             "'structural' origin"))
    enough = graph.walk(g, graph.seeds(g, "i1"), 1, 5)
    assert "Join" not in plan(enough) and [r.name for r in enough.collect()] == ["i1", "i10", "i100", "i1000", "i1001"]
    for part, limit in (("d1", 1), ("d1", 7), ("d", 4), ("i2999", 3), ("d2", 2000)):
        whole = graph.walk(g, graph.seeds(g, part), 2, None).orderBy("depth", "type", "name").limit(limit)
        assert graph.walk(g, graph.seeds(g, part), 2, limit).collect() == whole.collect()


def test_nodes_after_the_first_are_left_out_early(spark):
    nodes = spark.range(20_000).selectExpr("concat('n', id % 5000) name", "if(id % 7 = 0, 'x', 'y') type")
    some = graph.first_distinct(nodes, 4)
    first = lambda df: df.distinct().orderBy("type", "name").limit(4).collect()
    assert some.count() < 2000 and first(some) == first(nodes) and graph.first_distinct(nodes, 9_000).count() == 20_000


def test_regressions_keep_every_merge_of_the_two_weeks(spark):
    days = lambda n: DAY - dt.timedelta(days=n)
    changes = [("A-1", "status", "Reopened", DAY), ("A-1", "status", "Reopened", days(3)), ("A-1", "status", "Reopened", days(3)), ("A-2", "status", "Reopened", days(60)),
               ("A-2", "status", "Open", DAY), ("A-3", "status", "Reopened", days(14)), ("A-3", "status", "Reopened", DAY), (None, "status", "Reopened", DAY), ("A-4", "status", "Reopened", None)]
    changes = spark.createDataFrame(changes, "issue_key string, field string, to_value string, changed_at timestamp_ntz")
    merged = [("o/r", i, days(i)) for i in range(0, 31)] + [("o/r", 2, days(5)), ("o/r", 2, days(20)), ("o/r", 50, None), ("o/r", 51, days(17) + dt.timedelta(microseconds=1)),
                                                           (None, 52, days(1)), ("o/r", 53, dt.datetime(1969, 12, 31, 23))]
    prs = spark.createDataFrame(merged, "repo_full_name string, number long, merged_at timestamp_ntz")
    found = [(r.target, int(r.source.split("#")[1])) for r in graph.regressions(changes, prs).collect()]
    ends = {"A-1": [DAY, days(3)], "A-2": [days(60)], "A-3": [days(14), DAY]}
    wanted = {(k, n) for k, at in ends.items() for a in at for repo, n, t in merged if repo and t and a - dt.timedelta(days=14) < t < a}
    assert len(found) == len(set(found)) and set(found) == wanted
    assert ("A-1", 51) in wanted and ("A-1", 17) not in wanted and ("A-3", 14) not in wanted and len(wanted) == 44


def test_regressions_know_times_before_1970(spark):
    epoch = dt.datetime(1970, 1, 1)
    changes = spark.createDataFrame([("A-1", "status", "Reopened", epoch + dt.timedelta(hours=1))], "issue_key string, field string, to_value string, changed_at timestamp_ntz")
    prs = spark.range(40).selectExpr("'o/r' repo_full_name", "id number", "timestamp_ntz '1970-01-01' - make_dt_interval(cast(id as int), 1) merged_at")
    found = graph.regressions(changes, prs)
    assert sorted(int(r.source.split("#")[1]) for r in found.collect()) == list(range(14))


def test_related_issues_walk_every_step_however_many_seeds_there_are(spark):
    own = [(f"A-1{i:03}", "issue", "assigned_to", "ann", "developer", 1.0, "structural") for i in range(260)] + [("A-1", "issue", "assigned_to", "ann", "developer", 1.0, "structural")]
    far = [("A-2", "issue", "reported_by", "ann", "developer", 1.0, "structural"), ("A-2", "issue", "in_component", "c", "component", 1.0, "structural"),
           ("A-30", "issue", "blocked_by", "A-2", "issue", 1.0, "auto"), ("B-4", "issue", "in_component", "c", "component", 1.0, "structural"),
           ("pay", "business_process", "caused_by", "A-2", "issue", 1.0, "claude"), ("A-1007", "issue", "caused_by", "A-1008", "issue", 1.0, "claude")]
    g = settled(spark.createDataFrame(own + far, EDGE))
    found = {r.name: (r.depth, r.semantic) for r in graph.related_issues(g, "a-1", limit=None).collect()}
    seeds = {f"A-1{i:03}": (0, i in (7, 8)) for i in range(260)}
    assert found == seeds | {"A-2": (2, True), "A-30": (3, False)}
    assert {r.name for r in graph.related_issues(g, "a-1", 2, limit=None).collect()} == set(seeds) | {"A-2"}
    assert {r.name: r.depth for r in graph.related_issues(g, "a-1", 4, limit=None).collect()} == {k: v[0] for k, v in found.items()} | {"B-4": 4}


def test_related_issues_take_the_nearest_and_say_what_is_known(spark):
    g = spark.createDataFrame([("A-1", "issue", "assigned_to", "ann", "developer", 1.0, "structural"), ("A-9", "issue", "assigned_to", "ann", "developer", 1.0, "structural"),
                               ("A-2", "issue", "blocked_by", "A-1", "issue", 1.0, "claude")], EDGE)
    known = spark.createDataFrame([("A-1", "issue", "{}"), ("A-12", "issue", "{}"), ("A-9", "issue", '{"status": "Done", "summary": "pay"}'), ("A-9", "label", '{"status": "no"}')],
                                  "name string, type string, properties string")
    found = graph.related_issues(g, "A-1", known=known)
    assert [tuple(r) for r in found.select("name", "depth", "semantic", "status", "summary").collect()] == [
        ("A-12", 0, False, None, None), ("A-2", 1, True, None, None), ("A-9", 2, False, "Done", "pay")]
    assert [r.name for r in graph.related_issues(g, "A-1", limit=1).collect()] == ["A-2"]
