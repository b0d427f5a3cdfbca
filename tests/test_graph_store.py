"""Import graphs, and the stored graph: clearing, merging, incremental builds, notes and root causes."""

import pytest

from spindrift.operators import graph, graph_store
from spindrift.session import Workspace
from spindrift.sources import code
from spindrift.tools import Tools


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("path,wanted", [("a/b/../c", "a/c"), ("./a//b/.", "a/b"), ("a/../../b", "../b"), ("../../x", "../../x"), ("a/b/../../..", ".."), ("", ""), ("a/..", "")])
def test_folded(spark, path, wanted):
    assert spark.createDataFrame([(path,)], "p string").select(code.folded("p")).first()[0] == wanted


FILES = {
    "src/core/a.ts": "import { x } from './b';\nimport y from \"../util\"\nconst z = require('./c.js');\nimport fs from 'fs'",
    "src/core/b.ts": "export * from '../util/deep/d';\nimport './side';\nimport type { T } from './a'",
    "src/core/c.ts": "import {\n  many,\n  lines,\n} from '../../lib/tool'",
    "src/core/side.tsx": "const a = await import('../missing/one')",
    "src/util/index.ts": "import k from '../../../outside/k'",
    "src/util/deep/d.js": "//", "lib/tool.js": "require('./tool')", "lib/my file+x.py": "#",
    "node_modules/p/i.js": "require('./x')", "src/.hidden/h.ts": "import q from './q'", "dist/out.js": "require('./q')",
    "a/b/c/d/e/f/too_deep.ts": "import q from './q'", "src/notes.txt": "import q from './q'",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_scan_resolves_imports(spark, tree):
    found = code.files(spark, tree)
    assert {r.path for r in found.collect()} == {n for n in FILES if n.startswith(("src/core", "src/util", "lib"))}
    assert {(r.path, r.target, r.resolved) for r in code.imports(found).collect()} == {
        ("src/core/a.ts", "src/core/b.ts", True), ("src/core/a.ts", "src/util/index.ts", True), ("src/core/a.ts", "src/core/c.ts", True),
        ("src/core/b.ts", "src/util/deep/d.js", True), ("src/core/b.ts", "src/core/side.tsx", True), ("src/core/b.ts", "src/core/a.ts", True),
        ("src/core/c.ts", "lib/tool.js", True), ("src/core/side.tsx", "src/missing/one", False), ("src/util/index.ts", "../outside/k", False),
        ("lib/tool.js", "lib/tool.js", True)}
    edges = graph.module_imports(code.imports(found))
    assert {(r.source, r.target, r.origin) for r in edges.collect()} == {(a, b, "structural") for a, b in (
        ("src/core", "src/util"), ("src/core", "lib/tool.js"), ("src/core", "src/missing"), ("src/util", "../outside"))}


def test_packages(spark):
    docs = spark.createDataFrame([('{"name": "app", "dependencies": {"x": "1", "y": "2"}, "devDependencies": {"y": "3", "z": "1"}}',), ('{"dependencies": {"q": "1"}}',),
                                  ("no json",), ("[]",)], "doc string")
    assert rows(code.packages(docs)) == [("app", "x"), ("app", "y"), ("app", "z"), ("project", "q")]
    assert rows(graph.package_edges(code.packages(docs)).select("source", "type", "target"))[0] == ("app", "depends_on_pkg", "x")


ISSUE = ("issue_key string, summary string, issue_type string, status string, assignee string, reporter string, parent_key string, labels array<string>, "
         "components array<string>, created timestamp, updated timestamp")


def tables(spark, changed=False):
    def make(values, schema):
        return spark.createDataFrame([tuple(v) for v in values], schema)

    import datetime as dt
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2020, 6, 1)
    issues = [("A-1", "one", "Bug", "Done", "ann", "bob", None, ["l"], ["c"], old, old), ("A-2", "two", "Task", "Done", "ann", None, "A-1", ["l", "m"], None, old, old),
              ("A-3", "alone", "Task", "Done", None, None, None, None, None, old, old), (None, None, None, None, None, None, None, None, None, old, old)]
    if changed:
        issues[1] = ("A-2", "two!", "Task", "Open", "cid", "dora", None, ["m"], ["c"], old, new)
        issues.append(("A-4", "new", "Bug", "Open", "bob", None, "A-2", None, ["c"], new, new))
    commits = [("h1", "ann", old), ("h2", "eve", old), *([("h3", "cid", new)] if changed else [])]
    return {
        "issues": make(issues, ISSUE), "commits": make(commits, "hash string, author string, committed_at timestamp"),
        "commit_issue_refs": make([("h1", "A-1"), *([("h3", "A-4")] if changed else [])], "commit_hash string, issue_key string"),
        "commit_files": make([("h1", "src/a/x.py"), ("h1", "src/a/y.py"), *([("h3", "src/a/x.py")] if changed else [])], "commit_hash string, file_path string"),
        "pull_requests": make([("o/r", 7, "ann", old, old)], "repo_full_name string, number long, author string, updated_at timestamp, merged_at timestamp"),
        "pr_issue_refs": make([("o/r", 7, "A-1")], "repo_full_name string, pr_number long, issue_key string"),
        "pr_reviews": make([("o/r", 7, "bob")], "repo_full_name string, pr_number long, reviewer string"),
        "issue_links": make([("A-1", "A-2", "Blocks"), ("A-3", "A-1", "Causes")], "source_key string, target_key string, link_type string"),
        "issue_changelogs": make([("A-1", "status", "Reopened", old + dt.timedelta(days=3))], "issue_key string, field string, to_value string, changed_at timestamp")}


ASOF = "2020-07-01"


def with_notes(spark, held):
    edges = graph_store.merge(held.edges, spark.createDataFrame([("Flow", "business_process", "caused_by", "A-1", "issue", 1.0, "claude")], held.edges.schema))
    more = spark.createDataFrame([("Flow", "business_process", '{"k":1}'), ("Idea", "feature", "{}"), ("Gone", "feature", "{}")], held.entities.schema)
    import datetime as dt
    notes = spark.createDataFrame([("Idea", "why", "ann", dt.datetime(2020, 1, 2)), ("A-1", "late", "ann", None), ("A-1", "early", "bob", dt.datetime(2020, 1, 1))],
                                  held.observations.schema)
    return graph_store.Graph(edges, held.entities.unionByName(more), notes)


def test_incremental_build_equals_a_whole_one(spark):
    first = with_notes(spark, graph_store.rebuilt(graph_store.empty(spark), tables(spark), ASOF))
    later = tables(spark, changed=True)
    part, whole = graph_store.rebuilt(first, later, ASOF, since="2020-05-01"), graph_store.rebuilt(first, later, ASOF)
    scratch = graph_store.rebuilt(graph_store.empty(spark), later, ASOF)
    assert rows(part.edges) == rows(whole.edges) and rows(part.entities) == rows(whole.entities)
    manual = ("Flow", "business_process", "caused_by", "A-1", "issue", 1.0, "claude")
    assert rows(whole.edges) == sorted([*rows(scratch.edges), manual], key=repr)
    held = {(n, t): p for n, t, p in rows(whole.entities)}
    assert held["Flow", "business_process"] == '{"k":1}' and ("Idea", "feature") in held and ("Gone", "feature") not in held
    assert held["A-2", "issue"] == '{"summary":"two!","issueType":"Task","status":"Open"}' and held["eve", "developer"] == "{}" and ("A-3", "issue") in held
    assert rows(whole.observations) == rows(first.observations)


def test_clear_keeps_what_is_manual_or_noted(spark):
    held = graph_store.cleared(with_notes(spark, graph_store.rebuilt(graph_store.empty(spark), tables(spark), ASOF)))
    assert [r.origin for r in held.edges.collect()] == ["claude"]
    assert {(r.name, r.type) for r in held.entities.collect()} == {("Flow", "business_process"), ("Idea", "feature"), ("A-1", "issue")}


def test_merge_keeps_first_origin_and_last_weight(spark):
    schema = graph_store.empty(spark).edges.schema
    make = lambda *r: spark.createDataFrame([("a", "x", "t", "b", "x", *v) for v in r], schema)
    assert [(r.weight, r.origin) for r in graph_store.merge(make((1.0, "claude")), make((5.0, "auto"))).collect()] == [(5.0, "claude")]


@pytest.fixture
def tools(spark, tmp_path):
    first = with_notes(spark, graph_store.rebuilt(graph_store.empty(spark), tables(spark), ASOF))
    for name, df in {**tables(spark), **first.tables()}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return Tools(Workspace(spark, str(tmp_path)))


def test_root_causes_through_the_tools(tools):
    got = {(r.source, r.type, r.bucket) for r in tools.root_cause_analysis("a-1").collect()}
    assert got == {("A-3", "root_causes", "confirmed"), ("o/r#7", "probably_caused_by", "probable"), ("Flow", "caused_by", "manual")}
    added = tools.add_relationship("A-1", "issue", "Refund", "feature", "part_of")
    assert ("A-1", "issue", "part_of", "Refund", "feature", 1.0, "claude") in rows(added["graph_edges"])
    assert ("Refund", "feature", "{}") in rows(added["graph_entities"])


def test_observations_through_the_tools(tools):
    notes = tools.add_observation("A-1", "again", "ann", "2021-01-01")
    assert notes.count() == 4
    assert [r.content for r in tools.observations("A-1").collect()] == ["early", "late"]
    with pytest.raises(KeyError):
        tools.add_observation("nobody", "x", "ann", "2021-01-01")
    assert [r.content for r in tools.impact_analysis("A-1", 1)["observations"].collect()] == ["early", "late"]
    assert tools.business_context("idea")["observations"].count() == 1
    assert ("observation", None, 3) in {tuple(r) for r in tools.graph_stats().collect()}


def test_build_through_the_tools(tools):
    whole = tools.graph_build(ASOF)
    assert rows(whole["graph_edges"]) == rows(tools.t("graph_edges"))
