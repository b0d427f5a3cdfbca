import pytest
from pyspark.sql import functions as F

from spindrift.operators import estimate, graph, stats, store, vectors


def hours(spark, rows):
    df = spark.createDataFrame([(1, float(h), float(w)) for h, w in rows], "g int, hours double, weight double")
    found = estimate.base_hours(df, ["g"]).first()
    return found and found.base_hours


def test_base_hours(spark):
    assert hours(spark, []) is None
    assert hours(spark, [(h, 1) for h in (4, 6, 8, 10, 12)]) == pytest.approx(8)
    assert hours(spark, [(h, 1) for h in (1, 4, 6, 8, 10, 100)]) == pytest.approx(7)
    assert hours(spark, [(h, 1) for h in range(2, 21, 2)]) == pytest.approx(11)
    assert hours(spark, [(4, 0.3), (8, 0.5), (12, 0.2)]) == pytest.approx(7.6)
    assert hours(spark, [(4, 0), (8, 0)]) == pytest.approx(6)


@pytest.mark.parametrize("known,wanted,factor", [([("API", 1)], ["API"], 0.92), ([("API", 5)], ["api"], 0.6), ([("A", 2), ("B", 3)], ["a", "b"], 0.6),
                                                 ([("A", 20)], ["A"], 0.6), ([], ["A"], 1.0), ([("A", 3)], [], 1.0)])
def test_familiarity_factor(spark, known, wanted, factor):
    df = spark.createDataFrame(known, "component string, resolved_count int")
    assert estimate.familiarity_factor(df, wanted).first().factor == pytest.approx(factor)


def test_overlap_counts_repeats(spark):
    row = spark.range(1).select(estimate.overlap(F.array(F.lit("a"), F.lit("b")), ["a", "a", "c"]).alias("x")).first()
    assert row.x == pytest.approx(2 / 3)


def test_fallback_follows_not_in(spark):
    make = lambda names: spark.createDataFrame([(n, 1.0) for n in names], "assignee string, coefficient double")
    names = lambda c, g: sorted((r.assignee or "-", r.source) for r in estimate.with_fallback(make(c), make(g)).collect())
    assert names(["a"], ["a", "b", None]) == [("a", "context"), ("b", "general")]
    assert names(["a", None], ["b"]) == [("-", "context"), ("a", "context")]
    assert names([], ["b", None]) == [("-", "general"), ("b", "general")]


def test_task_hours_order(spark):
    schema = "issue_key string, time_spent int, worklog_seconds int, first_commit timestamp_ntz, last_commit timestamp_ntz, original_estimate int, created timestamp_ntz, resolved timestamp_ntz"
    import datetime as dt
    a, b = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 1, 12)
    rows = [("spent", 7200, 60, a, b, 3600, a, b), ("log", 0, 3600, a, b, 60, a, b), ("span", None, None, a, b, 60, a, b),
            ("guess", None, None, a, a, 1800, a, b), ("cycle", None, None, None, None, 0, a, b), ("none", None, None, None, None, None, b, dt.datetime(2023, 1, 1))]
    got = {r.issue_key: (r.hours, r.cycle_only) for r in estimate.task_hours(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"spent": (2.0, False), "log": (1.0, False), "span": (3.0, False), "guess": (0.5, False), "cycle": (8.0, True)}


def test_upsert_keeps_and_replaces(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, v int, o string")
    new = spark.createDataFrame([("b", 3, "z"), ("c", 4, "z")], "k string, v int, o string")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"], keep=("o",)).collect()) == [("a", 1, "x"), ("b", 3, "y"), ("c", 4, "z")]


def test_update_fields(spark):
    issues = spark.createDataFrame([("A-1", "x", False, None, None), ("A-2", "y", False, None, None)],
                                   "issue_key string, summary string, locally_modified boolean, modified_at timestamp_ntz, modified_fields array<string>")
    changed = store.update_fields(issues, "A-1", {"summary": "new"}, "2024-01-01")
    assert [(r.summary, r.locally_modified, r.modified_fields) for r in changed.orderBy("issue_key").collect()] == [("new", True, ["summary"]), ("y", False, None)]
    with pytest.raises(KeyError):
        store.update_fields(issues, "A-9", {"summary": "new"}, "2024-01-01")
    with pytest.raises(ValueError):
        store.update_fields(issues, "A-1", {"source": "new"}, "2024-01-01")
    assert store.update_fields(issues, "A-9", {}, "2024-01-01") is issues


def make_graph(spark, pairs):
    return spark.createDataFrame([(a, "n", "e", b, "n", 1.0) for a, b in pairs], "source string, source_type string, type string, target string, target_type string, weight double")


def test_walk_is_undirected_and_ends(spark):
    g = make_graph(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("d", "a"), ("x", "y")])
    got = {r["name"]: r["depth"] for r in graph.walk(g, graph.seeds(g, "a"), 5).collect()}
    assert got == {"a": 0, "b": 1, "d": 1, "c": 2}


def test_within_days_bounds(spark):
    import datetime as dt
    at = dt.datetime(2024, 3, 15)
    events = [(i, at - dt.timedelta(days=d)) for i, d in enumerate((0, 1, 5, 13.9, 14, 20))]
    found = graph.within_days(spark.createDataFrame([("p", at)], "probe string, at timestamp_ntz"),
                              spark.createDataFrame(events, "id int, event_at timestamp_ntz"), ties=("id",))
    assert sorted(r.id for r in found.collect()) == [1, 2, 3]


def test_hybrid_search_sources(spark):
    words = spark.createDataFrame([("a", 3.0), ("b", 2.0)], "k string, score double")
    near = spark.createDataFrame([("b", 0.9), ("c", 0.8)], "k string, score double")
    got = {r.k: (r.score, r.source) for r in vectors.hybrid_search(words, near, "k").collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61), "both")
    assert got["a"] == (pytest.approx(1 / 61 + 1 / 1060), "text") and got["c"][1] == "semantic"
    assert vectors.hybrid_search(words, None, "k").first().source == "text"


def test_cosine_of_zero_vector_is_null(spark):
    rows = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", None)], "k string, v array<float>")
    got = [(r.k, r.similarity) for r in vectors.semantic_search(rows, "k", "v", [1.0, 0.0], 5).collect()]
    assert got == [("b", 1.0), ("a", None)]


def test_grouped_counts_show_nulls(spark):
    df = spark.createDataFrame([("x",), (None,), ("x",)], "a string")
    assert sorted((r.facet, r.value or "", r.n) for r in stats.grouped_counts(df, ["a"]).collect()) == [("a", "", 1), ("a", "x", 2), ("total", "", 3)]


def test_edges_of_a_walk_and_incremental_build(spark):
    g = make_graph(spark, [("a", "b"), ("b", "c"), ("x", "y")])
    near = graph.walk(g, graph.seeds(g, "a"), 1)
    assert {(r["source"], r["target"]) for r in graph.edges_of(g, near).collect()} == {("a", "b"), ("b", "c")}
    none = lambda schema: spark.createDataFrame([], schema)
    issue = "issue_key string, issue_type string, assignee string, reporter string, parent_key string, labels array<string>, components array<string>, created timestamp, updated timestamp"
    issues = spark.sql("select i as issue_key, 'Bug' as issue_type, 'ann' as assignee, null as reporter, null as parent_key, array('l', null) as labels,"
                       " cast(null as array<string>) as components, timestamp '2020-01-01' as created, at as updated"
                       " from values ('A-1', timestamp '2020-01-01'), ('A-2', timestamp '2020-06-01'), (null, null) as v(i, at)")
    assert issues.columns == [c.split()[0] for c in issue.split(", ")]
    tables = {"issues": issues, "commits": none("hash string, author string, committed_at timestamp"), "commit_issue_refs": none("commit_hash string, issue_key string"),
              "commit_files": none("commit_hash string, file_path string"),
              "pull_requests": none("repo_full_name string, number long, author string, updated_at timestamp, merged_at timestamp"),
              "pr_issue_refs": spark.sql("select 'o/r' as repo_full_name, 7L as pr_number, 'A-1' as issue_key"),
              "issue_links": none("source_key string, target_key string, link_type string"),
              "issue_changelogs": none("issue_key string, field string, to_value string, changed_at timestamp")}
    built = lambda **kw: {(r["source"], r["type"], r["target"]) for r in graph.build(tables, "2020-07-01", **kw).collect()}
    second = {("A-2", "assigned_to", "ann"), ("A-2", "labeled", "l"), ("o/r#7", "implements", "A-1")}
    assert built() == second | {("A-1", "assigned_to", "ann"), ("A-1", "labeled", "l")}
    assert built(since="2020-05-01") == second
