"""Appended dumps, the front-matter sink and SQLite files."""

import random
import sqlite3

import pytest

from spindrift.sources import appended, front_matter, sqlite
from spindrift.streaming import ingest


@pytest.mark.parametrize("begins", [True, False])
def test_every_split_gives_every_record_once(tmp_path, begins):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab\n é") for _ in range(rng.randrange(30))) for _ in range(80)]
    data = "".join("\x1e" + t if begins else t + "\x1e" for t in texts).encode()
    (tmp_path / "d").write_bytes(data + (b"" if begins else b"unfinished"))
    for split in (1, 2, 7, 100, 10_000):
        reader = appended.Reader({"path": str(tmp_path), "separator": "\x1e", "begins": str(begins), "split_bytes": split})
        end = reader.sizes({})
        assert end == {str(tmp_path / "d"): len(data)}
        assert [v for p in reader.parts({}, end) for v, _ in reader.records(p)] == texts
        cut = len("".join("\x1e" + t if begins else t + "\x1e" for t in texts[:33]).encode())
        assert [v for p in reader.parts({str(tmp_path / "d"): cut}, end) for v, _ in reader.records(p)] == texts[33:]


def commit(n, text, files=("a.py",)):
    rows = "".join(f":100644 100644 1 2 M\t{f}\n" for f in files) + "".join(f"{n}\t0\t{f}\n" for f in files)
    return f"\x1eh{n}\x1fAnn\x1fa@x\x1f2024-01-0{n}T00:00:00+00:00\x1f{text}\n\x1f\n{rows}"


def test_follow_log_reads_what_is_new(spark, tmp_path):
    log, tables, mark = tmp_path / "logs", str(tmp_path / "tables"), str(tmp_path / "mark")
    log.mkdir()
    run = lambda: ingest.follow_log(spark, str(log), tables, "/r", mark, split_bytes=50)
    held = lambda name: ingest.log_table(spark, tables, name)
    (log / "one").write_text(commit(1, "PRJ-1 start") + commit(2, "PRJ-2 and PRJ-1", ("a.py", "b.py")))
    run()
    assert {r["hash"] for r in held("commits").read().collect()} == {"h1", "h2"} and held("commits").snapshot()[0] == 1
    run()
    assert held("commits").snapshot()[0] == 1  # nothing new, nothing written
    with (log / "one").open("a") as f:
        f.write(commit(3, "PRJ-9") + commit(2, "PRJ-3 amended", ("c.py",)))
    (log / "two").write_text(commit(4, "none"))
    run()
    assert {r["hash"]: r.message for r in held("commits").read().collect()} == {"h1": "PRJ-1 start", "h2": "PRJ-3 amended", "h3": "PRJ-9", "h4": "none"}
    assert sorted(tuple(r) for r in held("commit_issue_refs").read().collect()) == [("h1", "PRJ-1"), ("h2", "PRJ-3"), ("h3", "PRJ-9")]
    assert sorted((r.commit_hash, r.file_path) for r in held("commit_files").read().collect()) == [("h1", "a.py"), ("h2", "c.py"), ("h3", "a.py"), ("h4", "a.py")]


@pytest.mark.parametrize("old,new", [
    (b"# T\r\nbody\xff", b"---\nstatus: done\n---\n# T\r\nbody\xff"), (b"---\ntitle: a: b\nstatus: todo\n# note\n---\nx\n---\n", b"---\ntitle: a: b\nstatus: done\n# note\n---\nx\n---\n"),
    (b"---\n---\n\nx", b"---\nstatus: done\n---\n\nx"), (b"", b"---\nstatus: done\n---\n"), (b"---\r\nk: v\r\n---\r\nx", b"---\nk: v\nstatus: done\n---\nx"), (b"--- no", b"---\nstatus: done\n---\n--- no")])
def test_front_matter_rewrite(old, new):
    assert front_matter.rewritten(old, {"status": "done", "assignee": None}) == new


def test_front_matter_sink(spark, tmp_path):
    spark.dataSource.register(front_matter.FrontMatter)
    (tmp_path / "Done").mkdir()
    for i in range(6):
        (tmp_path / "Done" / f"{i}.md").write_bytes(b"---\nassignee: me\nstatus: todo\n---\n# T%d\n\xf0\r\n" % i)
    rows = spark.createDataFrame([(f"Done/{i}.md", f"s{i}", None) for i in range(5)] + [("New/x.md", "new", "ann")], "md_path string, status string, assignee string")
    save = lambda df: df.write.format("front_matter").option("path", str(tmp_path)).mode("append").save()
    save(rows.repartition(3))
    assert (tmp_path / "Done" / "3.md").read_bytes() == b"---\nassignee: me\nstatus: s3\n---\n# T3\n\xf0\r\n"
    assert (tmp_path / "New" / "x.md").read_bytes() == b"---\nstatus: new\nassignee: ann\n---\n"
    held = lambda: {f: f.read_bytes() for f in tmp_path.rglob("*") if f.is_file() and ".staging" not in str(f)}
    before = held()
    for bad in (spark.createDataFrame([("Done/1.md", "z"), ("../out.md", "z")], "md_path string, status string").repartition(2),
                spark.createDataFrame([("Done/1.md", "y"), ("Done/1.md", "z")], "md_path string, status string")):
        with pytest.raises(Exception):
            save(bad)
        assert held() == before


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.executescript("""CREATE TABLE users (id INTEGER PRIMARY KEY, email TEXT NOT NULL, score REAL DEFAULT 1.5, raw BLOB);
            CREATE TABLE "odd ""orders" (a TEXT, b INTEGER, user_id INTEGER REFERENCES users(id), PRIMARY KEY (a, b)) WITHOUT ROWID;
            CREATE UNIQUE INDEX by_email ON users (email, score);""")
        c.executemany("INSERT INTO users VALUES (?, ?, ?, ?)", [(i, f"u{i}@x", None if i % 7 == 0 else i / 2, b"\x00" if i % 2 else None) for i in range(1, 201)])
        c.executemany('INSERT INTO "odd ""orders" VALUES (?, ?, ?)', [("p", i, i) for i in range(5)])
    return path


def test_sqlite_filters_are_pushed(spark, db):
    users = sqlite.table(spark, db, "users")
    assert users.count() == 200 and users.rdd.getNumPartitions() == 8
    asked = lambda condition, limit=None: sqlite.where(spark, db, "users", condition, limit)
    found = asked("id > 20 and id <= 40 and email <> 'u30@x' and score is not null")
    assert {r.id for r in found.collect()} == {i for i in range(21, 41) if i != 30 and i % 7}
    assert {r.id for r in asked("email in ('u3@x', 'u5@x') or id = 9").collect()} == {3, 5, 9}
    assert users.filter("id < 5").count() == 4 and asked("id < 150").filter("id > 140").count() == 9 and users.count() == 200
    assert asked("id > 20", 7).count() == 7 and asked("email like '%9@x'", 12).count() == 12 and asked("email like '%9@x'").count() == 20
    spark.conf.set(sqlite.PUSH, "true")
    try:
        planned = lambda condition: sqlite.has_filter(spark.read.format("sqlite").options(path=db, table="users", push="true").load().filter(condition))
        assert not planned("id > 20 and email like 'u1%'") and planned("id > 20 and email like '%9@x'")
    finally:
        spark.conf.set(sqlite.PUSH, "false")
    reader = sqlite.PushingReader({"path": db, "table": "users"}, users.schema)
    from pyspark.sql.datasource import GreaterThan, StringContains

    assert list(reader.pushFilters([GreaterThan(("id",), 190), StringContains(("email",), "9"), GreaterThan(("raw",), b"a")])) == [StringContains(("email",), "9"), GreaterThan(("raw",), b"a")]
    assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == list(range(191, 201))
    assert sqlite.table(spark, db, 'odd "orders').count() == 5


def test_sqlite_catalog(spark, db):
    got = sqlite.catalog_of(spark, db, "src")
    assert {r.table_name for r in got["db_tables"].collect()} == {"users", 'odd "orders'}
    columns = {(r.table_name, r.column_name): (r.data_type, r.nullable, r.default_value, r.is_primary_key, r.ordinal_position) for r in got["db_columns"].collect()}
    assert columns["users", "score"] == ("REAL", True, "1.5", False, 3) and columns["users", "id"][3] and columns['odd "orders', "b"][3] and len(columns) == 7
    assert [tuple(r)[1:] for r in got["db_foreign_keys"].collect()] == [('odd "orders', "user_id", "users", "id")]
    indexes = {r.index_name: (r.table_name, r.columns, r.is_unique, r.is_primary) for r in got["db_indexes"].collect()}
    assert indexes["by_email"] == ("users", ["email", "score"], True, False)
    assert ('odd "orders', ["a", "b"], True, True) in indexes.values()
