"""Bucketed tables: files of untouched buckets stay, merges equal upserts, second writers are refused."""

import datetime as dt
import os

import pytest

from spindrift.operators import commits, tables
from spindrift.streaming import ingest

SCHEMA = "k string, v int, at timestamp_ntz"


def make(spark, rows):
    return spark.createDataFrame([(k, v, dt.datetime(2024, 1, d)) for k, v, d in rows], SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    made = tables.BucketedTable(spark, str(tmp_path), make(spark, []).schema, ["k"], buckets=8)
    assert made.read().count() == 0
    made.merge(make(spark, [(f"k{i}", i, 1) for i in range(50)]), "at")
    return made


def values(df):
    return {r.k: r.v for r in df.collect()}


def files(df):
    return {f: os.path.getmtime(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles()}


def test_merge_rewrites_touched_buckets_only(spark, table):
    number, before = table.snapshot()
    old = files(table.read())
    assert table.merge(make(spark, [("k7", 700, 2), ("k7", 600, 1), (None, 1, 1)]), "at") == number + 1
    after = table.snapshot()[1]
    changed = {b for b in after["held"] if after["held"][b] != before["held"].get(b)}
    assert 1 <= len(changed) <= 2
    new = files(table.read())
    same = {f for b in set(after["held"]) - changed for f in old if f"_bucket={b}/" in f}
    assert same and all(new[f] == old[f] for f in same)
    assert values(table.read()) == {f"k{i}": i for i in range(50)} | {"k7": 700, None: 1}
    assert values(table.read(before)) == {f"k{i}": i for i in range(50)}  # an older snapshot can still be read


def test_second_writer_is_refused(spark, table, monkeypatch):
    batch = make(spark, [("k1", -1, 3)])
    stale = table.snapshot()
    other = tables.BucketedTable(spark, table.folder, table.schema, ["k"])
    other.merge(make(spark, [("k2", -2, 3)]), "at")
    monkeypatch.setattr(table, "snapshot", lambda: stale)
    held = set(os.listdir(table.folder))
    with pytest.raises(commits.Conflict):
        table.merge(batch, "at")
    assert set(os.listdir(table.folder)) == held
    monkeypatch.undo()
    assert ingest.patiently(lambda: table.merge(batch, "at")) == 3
    assert values(table.read()) == {f"k{i}": i for i in range(50)} | {"k1": -1, "k2": -2}


def test_children_are_replaced_by_parent(spark, tmp_path):
    schema = "issue_key string, body string"
    made = tables.BucketedTable(spark, str(tmp_path), spark.createDataFrame([], schema).schema, ["issue_key"], buckets=4)
    put = lambda parents, rows: made.replace(spark.createDataFrame([(p,) for p in parents], "issue_key string"), ["issue_key"], spark.createDataFrame(rows, schema))
    put(["a", "b"], [("a", "1"), ("a", "2"), ("b", "3")])
    put(["a", "c"], [("c", "4")])
    assert sorted(tuple(r) for r in made.read().collect()) == [("b", "3"), ("c", "4")]
    with pytest.raises(ValueError):
        made.replace(spark.createDataFrame([("x",)], "body string"), ["body"], spark.createDataFrame([], schema))


def test_empty_batch_commits_nothing(spark, table):
    assert table.merge(make(spark, []), "at") == 1


def test_sync_goes_on_after_a_failure(spark):
    seen = []

    def broken():
        yield 1
        raise OSError("gone")

    failed = tables.sync(spark, {"a": broken, "b": lambda: [2, 3]}, lambda name, batch: seen.append((name, batch)))
    assert seen == [("a", 1), ("b", 2), ("b", 3)] and isinstance(failed["a"], OSError) and failed["b"] is None
