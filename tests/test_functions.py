import datetime as dt

import pytest
from pyspark.sql import functions as F

from spindrift.functions import rendering, sql_gate, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_issue_keys(spark):
    keys = lambda t: one(spark, text.issue_keys(F.lit(t)))
    assert keys("fix: closes PROJ-007 and PROJ-7, AB1-20") == ["PROJ-7", "AB1-20"]
    assert keys("proj-1 is lower case") == []
    assert keys("PROJ-000") == ["PROJ-0"]


@pytest.mark.parametrize("path,module", [("src/a/b.ts", "src/a"), ("a.ts", "a.ts"), ("/src/a.ts", "/src/a.ts"), ("src//a/b", "src/a")])
def test_module_name(spark, path, module):
    assert one(spark, text.module_name(F.lit(path))) == module


def test_matches_needs_all_terms(spark):
    t = F.lit("Payment flow breaks, on retry")
    assert one(spark, text.matches(t, "the retry PAYMENT"))
    assert not one(spark, text.matches(t, "retry refund"))
    assert not one(spark, text.matches(t, "the of"))
    assert not one(spark, text.matches(F.lit(None).cast("string"), "retry"))


@pytest.mark.parametrize("n,said", [(0, "0B"), (512, "512B"), (1023, "1023B"), (1024, "1KB"), (1536, "2KB"), (1048576, "1MB"),
                                    (1572864, "2MB"), (1073741824, "1GB"), (2899102925, "3GB")])
def test_format_bytes(spark, n, said):
    assert one(spark, rendering.format_bytes(F.lit(n).cast("long"))) == said


@pytest.mark.parametrize("n,said", [(3600, "1h"), (5400, "1h 30m"), (120, "2m"), (0, "0m")])
def test_format_time_spent(spark, n, said):
    assert one(spark, rendering.format_time_spent(F.lit(n))) == said


def test_business_hours(spark):
    day = dt.date(2024, 1, 1)  # a Monday
    rows = [(day + dt.timedelta(a), day + dt.timedelta(b)) for a in range(8) for b in range(-2, 25)]
    got = spark.createDataFrame(rows, "a date, b date").select("a", "b", rendering.business_hours(F.col("a"), F.col("b")).alias("h")).collect()
    for r in got:
        days = [r.a + dt.timedelta(i) for i in range((r.b - r.a).days + 1)]
        assert r.h == 8 * sum(d.weekday() < 5 for d in days)


GOOD = ["SELECT * FROM users", "EXPLAIN SELECT * FROM users", "SHOW TABLES", "DESCRIBE users", "DESC users",
        "WITH cte AS (SELECT 1) SELECT * FROM cte", "WITH a AS (SELECT max(x) FROM t), b AS (SELECT 1) SELECT * FROM a, b",
        "SELECT 1;", "select * from users"]
BAD = ["", "   ", "INSERT INTO users VALUES (1)", "UPDATE users SET name = 'x'", "DELETE FROM users", "DROP TABLE users",
       "ALTER TABLE users ADD COLUMN age INT", "TRUNCATE TABLE users", "CREATE TABLE x (id INT)", "SELECT 1; SELECT 2",
       "SELECT * FROM users WHERE DELETE = 1", "drop table users", "WHATEVER something"]


@pytest.mark.parametrize("sql", GOOD)
def test_reading_statements_pass(sql):
    assert sql_gate.check(sql)


@pytest.mark.parametrize("sql", BAD)
def test_others_do_not(sql):
    with pytest.raises(sql_gate.Rejected):
        sql_gate.check(sql)


def test_gate_limits_rows(spark):
    assert sql_gate.run(spark, "SELECT id FROM range(5000)").count() == 1000
