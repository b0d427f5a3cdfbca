import datetime as dt
import json

from spindrift.operators.store import high_water
from spindrift.sources import csv_export, dumps
from spindrift.streaming import ingest

HEAD = ["Summary", "Issue key", "Issue id", "Issue Type", "Status", "Assignee", "Created", "Updated", "Time Spent", "Labels", "Labels",
        "Comment", "Log Work", "Inward issue link (Blocks)", "Custom field (Story Points)", "Custom field (Team)"]
ROW = ["First", "CSV-1", "1", "Task", "Done", "John", "15/Jan/25 10:00 AM", "16/Jan/25 12:00 PM", "3600", "a", "b",
       "15/Jan/25 11:00 AM;john.doe;First; comment", "Implementation;15/Jan/25 09:00 AM;john.doe;3600", "CSV-2", "5", "Backend"]


def test_csv_export(spark, tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(",".join(HEAD) + "\n" + ",".join(ROW) + "\n\nMinimal,CSV-3\n")
    rows, layout = csv_export.read(spark, str(path))
    issues = {r.issue_key: r for r in csv_export.issues(rows, layout).collect()}
    one = issues["CSV-1"]
    assert (one.project_key, one.created, one.updated) == ("CSV", dt.datetime(2025, 1, 15, 10), dt.datetime(2025, 1, 16, 12))
    assert (one.labels, one.story_points, one.time_spent, json.loads(one.custom_fields)["Team"]) == (["a", "b"], 5.0, 3600, "Backend")
    assert issues["CSV-3"].summary == "Minimal" and issues["CSV-3"].labels == [] and issues["CSV-3"].created is None
    comment = csv_export.comments(rows, layout).first()
    assert (comment.author, comment.body, comment.created) == ("john.doe", "First; comment", dt.datetime(2025, 1, 15, 11))
    log = csv_export.worklogs(rows, layout).first()
    assert (log.author, log.time_spent_seconds, log.time_spent) == ("john.doe", 3600, "1h")
    assert [tuple(r) for r in csv_export.links(rows, layout).collect()] == [("CSV-2", "CSV-1", "Blocks", "inward")]
    assert csv_export.read(spark, str(path), since="2025-02-01")[0].count() == 1


def test_csv_dates(spark):
    from pyspark.sql import functions as F
    cases = {"1/Feb/99 12:00 AM": dt.datetime(1999, 2, 1), "1/Xyz/24 1:05 PM": dt.datetime(2024, 1, 1, 13, 5), "nonsense": None, None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", csv_export.jira_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == cases


ISSUE = {"key": "P-1", "id": "9", "fields": {"summary": "S", "status": {"name": "Done", "statusCategory": {"name": "Done"}}, "issuetype": {"name": "Bug"},
         "labels": ["x"], "components": [{"name": "API"}], "timespent": 60, "customfield_10016": 3, "customfield_1": "v", "created": "2025-01-15T10:00:00.000+0000",
         "issuelinks": [{"type": {"name": "Blocks"}, "outwardIssue": {"key": "P-2"}}, {"inwardIssue": {"key": "P-3"}}]},
         "changelog": {"histories": [{"created": "2025-01-16T10:00:00.000+0000", "author": {"displayName": "A"},
                       "items": [{"field": "status", "fromString": "Open", "toString": "Done"}, {"field": "assignee", "toString": "B"}]}]}}


def test_issue_dump(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps(ISSUE) + "\n")
    rows = dumps.raw(spark, str(tmp_path / "i.json"))
    one = dumps.issues(rows).first()
    assert (one.issue_key, one.project_key, one.status_category, one.labels, one.components, one.story_points, one.time_spent) == (
        "P-1", "P", "Done", ["x"], ["API"], 3.0, 60)
    assert set(json.loads(one.custom_fields)) == {"customfield_10016", "customfield_1"}
    assert [(r.field, r.to_value) for r in dumps.changelogs(rows).orderBy("field").collect()] == [("assignee", "B"), ("status", "Done")]
    assert sorted((r.source_key, r.target_key, r.link_type) for r in dumps.links(rows).collect()) == [("P-1", "P-2", "Blocks"), ("P-3", "P-1", "Related")]


def test_pull_request_dump(spark, tmp_path):
    docs = [{"number": 1, "title": "PROJ-01", "body": "and PROJ-1", "state": "closed", "merged_at": "2025-01-01T00:00:00Z", "user": {"login": "u"}, "additions": 3},
            {"number": 2, "title": "t", "state": "closed"}, {"number": 3, "title": "t", "state": "open"}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, docs)))
    prs = dumps.pull_requests(dumps.raw(spark, str(tmp_path / "p.json")), "o/r")
    assert [(r.state, r.additions) for r in prs.orderBy("number").collect()] == [("merged", 3), ("closed", 0), ("open", 0)]
    assert [tuple(r) for r in dumps.pr_refs(prs).collect()] == [("o/r", 1, "PROJ-1")]


def test_board_and_imports(spark, tmp_path):
    folder = tmp_path / "Backlog" / "epic1"
    folder.mkdir(parents=True)
    (folder / "t.md").write_text("---\njira_key: P-1\nassignee: me\n---\n# Title\ntext")
    (folder / "u.md").write_text("no heading")
    got = {r.title: r for r in dumps.board_tasks(spark, str(tmp_path)).collect()}
    assert (got["Title"].jira_key, got["Title"].column_name, got["Title"].epic) == ("P-1", "Backlog", "epic1") and "Untitled" in got
    (tmp_path / "a.ts").write_text("import x from './b';\nconst y = require('../c'); import z from 'lib';")
    assert sorted(r.target for r in dumps.imports(spark, str(tmp_path)).collect()) == ["../c", "./b"]
    (tmp_path / "package.json").write_text(json.dumps({"dependencies": {"a": "1"}, "devDependencies": {"b": "1", "a": "2"}}))
    assert sorted(r.package for r in dumps.packages(spark, str(tmp_path / "package.json")).collect()) == ["a", "b"]


def test_incremental_ingest(spark, tmp_path):
    landing, table, mark = (str(tmp_path / n) for n in ("landing", "table", "mark"))
    schema = spark.createDataFrame([], "k string, v int, at timestamp_ntz").schema
    put = lambda rows: spark.createDataFrame([(k, v, dt.datetime(2024, 1, d)) for k, v, d in rows], schema).write.mode("append").parquet(landing)
    run = lambda: ingest.ingest(spark, landing, table, schema, ["k"], "at", mark)
    put([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)])
    run()
    put([("b", 5, 3)])
    run()
    run()
    now = ingest.current(spark, table, schema)
    assert sorted((r.k, r.v) for r in now.collect()) == [("a", 2), ("b", 5)]
    assert high_water(now, "k", "at").filter("k = 'b'").first().since == dt.datetime(2024, 1, 2, 23, 59)
