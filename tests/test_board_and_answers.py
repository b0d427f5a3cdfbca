"""Boards, and the tools' search and estimate answers."""

import datetime as dt

import pytest

from spindrift.operators import board
from spindrift.session import Workspace
from spindrift.tools import Tools


def columns(spark, names=("backlog", "build", "done")):
    return spark.createDataFrame([(i, n, "skill" if n == "build" else "system") for i, n in enumerate(names)], "place long, name string, type string")


def names(df):
    return [r.name for r in df.orderBy("place").collect()]


def test_pipeline_keeps_order(spark):
    skills = spark.createDataFrame([(3, "ship"), (1, "test"), (2, "build"), (4, "test")], "place long, name string")
    made = board.pipeline(columns(spark), skills)
    assert names(made) == ["backlog", "build", "test", "ship", "done"]
    assert {r.name: r.next for r in board.following(made).collect()} == {"backlog": "build", "build": "test", "test": "ship", "ship": "done", "done": None}
    assert names(board.reordered(made, ["done", "nowhere", "test"])) == ["done", "test"] and names(board.reordered(made, [])) == []
    assert names(board.pipeline(columns(spark, ()), skills)) == ["test", "build", "ship"]


NOW = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize("value,unit,shown", [(0, "hours", {"a", "b", "c", "d", "e", "f"}), (2, "hours", {"a", "b", "d", "e"}), (3, "days", {"a", "b", "c", "d", "e"}),
                                              (1, "months", {"a", "b", "c", "d", "e"}), (72, "weeks", {"a", "b", "c", "d", "e"})])
def test_card_visibility(spark, value, unit, shown):
    hours = lambda n: NOW - dt.timedelta(hours=n)
    cards = spark.createDataFrame([("a", "backlog", "x", None), ("b", "build", "x", None), ("c", "done", "x", hours(50)), ("d", "lost", "x", None), ("e", None, "x", None),
                                   ("f", "done", "x", None), ("g", "build", "y", None)], "id string, column_name string, epic string, updated_at timestamp_ntz")
    got = {r.id: r.shown_in for r in board.shown(cards, columns(spark), str(NOW), "x", done_value=value, done_unit=unit).collect()}
    assert set(got) == shown and got["d"] == got["e"] == "backlog" and got["b"] == "build"
    hidden = board.shown(cards, columns(spark), str(NOW), skills=["test"])
    assert {r.id: r.shown_in for r in hidden.collect()}["b"] == "backlog"


ISSUE = ("issue_key string, summary string, description string, issue_type string, status string, status_category string, assignee string, parent_key string, "
         "components array<string>, created timestamp_ntz, updated timestamp_ntz, resolved timestamp_ntz, time_spent long, original_estimate long, embedding array<double>")


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ws"))
    day = lambda n: dt.datetime(2024, 1, n)
    issue = lambda key, text, spent, done=True, vector=None, kind="Story", parent=None: (
        key, text, None, kind, "Closed" if done else "Open", "Done" if done else "To Do", "Ann Lee", parent, ["pay"], day(1), day(8), day(8) if done else None, spent, 7200 if spent else None, vector)
    issues = [issue("P-1", "refunding orders twice", 7200, vector=[1.0, 0.0]), issue("P-2", "an order for two or three refunds", 14400, vector=[0.0, 1.0]),
              issue("P-3", "refund the order", 3600), issue("P-4", "cycle counts only", None), issue("P-5", "orders open", 100, done=False), issue("P-6", "a bug", 1800, kind="Bug", parent="P-1")]
    made = {"issues": (issues, ISSUE), "issue_links": ([("P-3", "P-5", "Causes")], "source_key string, target_key string, link_type string"),
            "issue_worklogs": ([("P-1", "Bo", 60)], "issue_key string, author string, time_spent_seconds long"),
            "issue_changelogs": ([("P-2", "assignee", "Cy", day(2))], "issue_key string, field string, to_value string, changed_at timestamp_ntz"),
            "commits": ([("h", "Di", day(2)), ("i", "Di", day(3))], "hash string, author string, committed_at timestamp_ntz"),
            "commit_files": ([], "commit_hash string, additions long, deletions long"),
            "commit_issue_refs": ([("h", "P-3"), ("i", "P-3")], "commit_hash string, issue_key string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return Tools(Workspace(spark, folder))


def test_hybrid_search_goes_by_stems_and_covers(tools):
    assert [r.issue_key for r in tools.hybrid_search("refunds order").collect()] == ["P-1", "P-3", "P-2"]  # by the words between
    best = tools.hybrid_search("refunds order", [0.0, 1.0]).collect()
    assert (best[0].issue_key, best[0].found_by) == ("P-2", "both")
    assert tools.hybrid_search("the of").count() == 0


def test_estimate_predicts(tools):
    found = tools.estimate("refunded orders", "ann", "2024-02-01", components=["pay"])
    one = found["prediction"].first()
    assert (one["mode"], one.tasks, one.coefficient_source) == ("predicted", 3, "context") and one.coefficient == 1.0 and one.predicted_hours == pytest.approx(one.base_hours)
    assert one.coefficient_with_bugs == pytest.approx(1.25)
    assert {(r.developer, r.tasks, r.bugs, r.commits) for r in found["profiles"].collect()} == {("Bo", 1, 1, 0), ("Cy", 1, 0, 0), ("Di", 1, 1, 2)}
    assert found["familiarity_factor"].first().factor == pytest.approx(1 - 0.08 * 4)


def test_estimate_by_cycle_times(tools):
    one = tools.estimate("cycle counts", "ann", "2024-02-01").get("prediction").first()
    assert (one["mode"], one.least_days, one.most_days, one.predicted_hours) == ("range", 6, 6, None)


def test_estimate_without_a_match_takes_the_latest(tools):
    assert tools.estimate("nothing like it", "ann", "2024-02-01", limit=2)["tasks"].count() == 2
