"""Git logs, reviews, releases, catalogs, proxied issues, batch saves and stems."""

import datetime as dt
import json

from pyspark.sql import functions as F

from spindrift.functions.stemming import stem, stemmed_hits
from spindrift.operators import store
from spindrift.sources import catalog, dumps, git_log, proxy


def landed(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")


def test_comments_and_worklogs(spark):
    text = {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "Rich"}]}]}
    rows = landed(spark, {"key": "P-1", "fields": {
        "comment": {"comments": [{"id": "7", "author": {"displayName": "A"}, "body": "plain", "created": "2025-01-15T10:00:00.000+0000"}, {"body": text}]},
        "worklog": {"worklogs": [{"timeSpent": "1h", "timeSpentSeconds": 3600, "started": "2025-01-15T10:00:00.000+0000"}]}}}, {"key": "P-2", "fields": {}})
    got = {r.comment_id: r for r in dumps.comments(rows).collect()}
    assert set(got) == {"7", ""} and (got["7"].issue_key, got["7"].author, got["7"].body) == ("P-1", "A", "plain")
    assert got[""].body.strip() == "Rich" and got[""].created is None
    assert [(r.time_spent, r.time_spent_seconds, r.author, r.comment) for r in dumps.worklogs(rows).collect()] == [("1h", 3600, None, None)]


def test_reviews_files_and_releases(spark):
    one = dumps.reviews(landed(spark, {"id": 5, "pull_request_url": "https://x/pulls/12", "user": None, "state": "APPROVED"}), "o/r").first()
    assert (one.repo_full_name, one.pr_number, one.review_id, one.reviewer, one.state) == ("o/r", 12, 5, None, "APPROVED")
    one = dumps.review_comments(landed(spark, {"id": 6, "pr_number": 3, "user": {"login": "u"}, "path": "a.py", "line": 4}), "o/r").first()
    assert (one.pr_number, one.author, one.path, one.line, one.body) == (3, "u", "a.py", 4, None)
    got = dumps.pr_files(landed(spark, {"pr_number": 1, "filename": "a", "status": "removed", "additions": 2}, {"pr_number": 1, "filename": "b", "status": "odd"}), "o/r")
    assert sorted((r.file_path, r.status, r.additions, r.deletions) for r in got.collect()) == [("a", "deleted", 2, 0), ("b", "modified", 0, 0)]
    one = dumps.releases(landed(spark, {"id": 1, "tag_name": "v1", "author": {"login": "u"}, "prerelease": True}), "o/r").first()
    assert (one.tag_name, one.author, one.draft, one.prerelease, one.published_at) == ("v1", "u", False, True, None)


LOG = ("\x1eh1\x1fAnn\x1fa@x\x1f2025-01-02T00:00:00+00:00\x1fPROJ-1 first\n\nbody\n\x1f\n:100644 100644 1 2 M\tsrc/a.py\n:100644 000000 1 0 D\told name.py\n"
       ":100644 100644 1 2 R090\tx.py\ty.py\n3\t1\tsrc/a.py\n0\t9\told name.py\n-\t-\tx.py => y.py\n"
       "\x1eh0\x1fBob\x1fb@x\x1f2024-01-01T00:00:00+00:00\x1fempty\n\x1f\n")


def test_git_log(spark, tmp_path):
    (tmp_path / "log").write_text(LOG)
    log = git_log.read(spark, str(tmp_path / "log"), "/r")
    got = {r.hash: r for r in git_log.commits(log).collect()}
    assert set(got) == {"h0", "h1"} and got["h1"].message == "PROJ-1 first\n\nbody" and got["h1"].parents == [] and got["h1"].email == "a@x"
    assert sorted((r.file_path, r.status, r.additions, r.deletions) for r in git_log.commit_files(log).collect()) == [
        ("old name.py", "deleted", 0, 9), ("src/a.py", "modified", 3, 1), ("y.py", "renamed", 0, 0)]
    assert [r.hash for r in git_log.read(spark, str(tmp_path / "log"), "/r", since="2025-01-01").collect()] == ["h1"]


def test_catalog(spark):
    rows = spark.createDataFrame([("t", "i", "b", True, False, 2), ("t", "i", "a", True, False, 1), ("s.t", "j", "c", False, True, 1)],
                                 "table_name string, index_name string, column_name string, is_unique boolean, is_primary boolean, position int")
    got = sorted((r.table_name, r.index_name, r.columns, r.is_unique, r.is_primary) for r in catalog.indexes(rows, "db").collect())
    assert got == [("s.t", "t", ["c"], False, True), ("t", "i", ["a", "b"], True, False)]
    cells = spark.createDataFrame([("t", "a", "int", "NO", None, 1), ("t", "b", "int", "YES", "0", 2)],
                                  "table_name string, column_name string, data_type string, is_nullable string, column_default string, ordinal_position int")
    keys = spark.createDataFrame([("t", "a"), ("t", "a")], "table_name string, column_name string")
    got = sorted((r.column_name, r.nullable, r.default_value, r.is_primary_key) for r in catalog.columns(cells, keys, "db").collect())
    assert got == [("a", False, None, True), ("b", True, "0", False)]


def test_proxied_issues(spark):
    rows = landed(spark, {"key": "X-1", "id": 9, "fields": {"summary": "S", "status": {"name": "Open"}, "labels": ["a", 1, None, "b"], "priority": {"name": True},
                          "components": [{"name": "API"}, {}, {"name": 3}], "story_points": "5", "resolution": {"name": {"k": 1}}, "created": "2025-01-15T10:00:00.000+0000"}},
                  {"fields": {"story_points": 2.5, "labels": "no list"}})
    got = {r.issue_key: r for r in proxy.issues(rows).collect()}
    one, none = got["X-1"], got[""]
    assert (one.project_key, one.issue_id, one.status, one.labels, one.components, one.priority) == ("X", "9", "Open", ["a", "b"], ["API"], "true")
    assert one.story_points is None and one.resolution == '{"k":1}' and one.created is not None and one.sprint is None
    assert none.story_points == 2.5 and none.labels == [] and none.components == [] and none.summary == ""
    own = proxy.issues(rows, {"summary": "fields.components[].name"}).filter("issue_key = 'X-1'").first()
    assert own.summary == '["API",3]'
    details = spark.createDataFrame([("X-1", "more"), ("Y-1", "other")], "issue_key string, description string")
    assert {r.issue_key: r.description for r in proxy.with_descriptions(proxy.issues(rows), details).collect()} == {"X-1": "more", "": None}


def test_batches(spark):
    issues = spark.createDataFrame([("A-1", "old"), ("A-2", "stays"), (None, "none")], "issue_key string, summary string")
    child = spark.createDataFrame([("A-1", 1), ("A-2", 2)], "issue_key string, n int")
    link = spark.createDataFrame([("A-1", "A-2"), ("A-2", "A-1")], "source_key string, target_key string")
    old = {"issues": issues, "issue_comments": child, "issue_changelogs": child, "issue_worklogs": child, "issue_links": link}
    new = {"issues": spark.createDataFrame([("A-1", "new"), ("A-1", "new"), (None, "again")], issues.schema), "issue_comments": spark.createDataFrame([("A-1", 9)], child.schema)}
    out = store.save_batch("issues", old, new)
    assert sorted(map(tuple, out["issues"].collect()), key=str) == [("A-1", "new"), ("A-2", "stays"), (None, "again")]
    assert sorted(map(tuple, out["issue_comments"].collect())) == [("A-1", 9), ("A-2", 2)]
    assert [tuple(r) for r in out["issue_worklogs"].collect()] == [("A-2", 2)] and [tuple(r) for r in out["issue_links"].collect()] == [("A-2", "A-1")]
    tables = {"db_tables": spark.createDataFrame([("a", "s", "t"), ("b", "s", "t")], "source_name string, schema_name string, table_name string")}
    assert [r.source_name for r in store.delete_schema(tables, "a")["db_tables"].collect()] == ["b"]
    assert store.save_schema(tables, tables)["db_tables"].count() == 2


def test_stems(spark):
    wanted = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing",
              "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
              "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adoption": "adopt", "effective": "effect", "rate": "rate",
              "controll": "control", "payments": "payment", "payment": "payment", "is": "is"}
    assert {w: stem(w) for w in wanted} == wanted
    docs = spark.createDataFrame([(1, "Payments failing"), (2, "payment failed twice"), (3, "payment"), (4, None), (5, "")], "id long, t string")
    hits = {r.id: r.hits for r in stemmed_hits(docs, ["id"], F.col("t"), "failed payments").collect()}
    assert set(hits) == {1, 2} and hits[1] == 1.0 and abs(hits[2] - 2 / 3) < 1e-9
    assert stemmed_hits(docs, ["id"], F.col("t"), "the").count() == 0


def test_stemmed_issue_search(spark):
    import functools

    from spindrift.operators.search import query_issues

    rows = [("A-1", "Payments", "fail"), ("A-2", "payment", "failing"), ("A-3", "failures of payment", None), ("A-4", None, None)]
    issues = spark.createDataFrame([(k, "A", s, d, "Bug", "Open", "x", i) for i, (k, s, d) in enumerate(rows)],
                                   "issue_key string, project_key string, summary string, description string, issue_type string, status string, assignee string, updated int")
    keys = lambda df: [r.issue_key for r in df.collect()]
    ask = functools.partial(query_issues, issues)
    assert keys(ask(search="payment failed", stemmed=True)) == ["A-2", "A-1"] and keys(ask(search="payment failed")) == []
    assert keys(ask(search="payment")) == ["A-3", "A-2"] and keys(ask(search="ayment")) == ["A-3", "A-2", "A-1"]
    assert keys(ask(search="payment", stemmed=True, limit=1)) == ["A-3"]
