"""Tables and catalogs of SQLite files, read by tasks with filters and a row cap pushed down.

    spark.dataSource.register(sqlite.Sqlite)
    spark.read.format("sqlite").option("path", file).option("table", "t").load()

A table is split by ranges of its rowid. Filters on plainly typed columns become part of each task's SQL where
where() asks for it; limit caps the rows of each part, for use with a limit on the whole. Files are opened for reading only, on each executor.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
                                    IsNull, LessThan, LessThanOrEqual, StringStartsWith)
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

from spindrift.session import settled
from spindrift.sources import catalog

PARTS = 8
PUSH = "spark.sql.python.filterPushdown.enabled"
#: Operators of filters that SQLite decides as Spark does for values of one type.
COMPARED = {EqualTo: "=", EqualNullSafe: "IS", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def type_of(declared: str):
    """By the affinity of a column's declared type."""
    d = (declared or "").upper()
    if "INT" in d:
        return LongType()
    if re.search("CHAR|CLOB|TEXT|DATE|TIME", d):
        return StringType()
    return BinaryType() if not d or "BLOB" in d else DoubleType()


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


@dataclass
class Range(InputPartition):
    low: int | None
    high: int | None


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.query = options["path"], options.get("table"), options.get("query")
        self.parts, self.limit = int(options.get("parts", PARTS)), options.get("limit")
        self.schema, self.where, self.values = schema, [], []

    def _from(self) -> str:
        return quoted(self.table) if self.table else f"({self.query})"

    def partitions(self) -> list[Range]:
        if not self.table:
            return [Range(None, None)]
        with _open(self.path) as db:
            try:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {self._from()}").fetchone()
            except sqlite3.OperationalError:  # a table without rowid
                return [Range(None, None)]
        if low is None:
            return []
        step = max(1, -(-(high - low + 1) // self.parts))
        return [Range(at, min(at + step - 1, high)) for at in range(low, high + 1, step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            values += [partition.low, partition.high]
        sql = f"SELECT {', '.join(quoted(f.name) for f in self.schema)} FROM {self._from()}"
        sql += f" WHERE {' AND '.join(where)}" if where else ""
        sql += f" LIMIT {int(self.limit)}" if self.limit else ""
        kinds = [f.dataType for f in self.schema]
        with _open(self.path) as db:
            for row in db.execute(sql, values):
                yield tuple(_as(v, k) for v, k in zip(row, kinds))


class PushingReader(Reader):
    """A reader for sessions that push filters into Python's sources."""

    def pushFilters(self, filters: list[Filter]):
        plain = {f.name for f in self.schema if isinstance(f.dataType, (LongType, StringType, DoubleType))}
        for f in filters:
            names = getattr(f, "attribute", ())
            made = self._sql(f, quoted(names[0])) if len(names) == 1 and names[0] in plain else None
            if made is None:
                yield f
            else:
                self.where.append(made[0])
                self.values += made[1]

    @staticmethod
    def _sql(f: Filter, name: str):
        if type(f) in COMPARED and isinstance(f.value, (int, float, str)):
            return f"{name} {COMPARED[type(f)]} ?", [f.value]
        if isinstance(f, In) and all(isinstance(v, (int, float, str)) for v in f.value):
            return f"{name} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{name} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        if isinstance(f, StringStartsWith):
            return f"substr({name}, 1, ?) = ?", [len(f.value), f.value]
        return None


def _as(value, kind):
    """A value of the column's type; SQLite may hold others, which are null then."""
    if isinstance(kind, LongType):
        return value if isinstance(value, int) else None
    if isinstance(kind, DoubleType):
        return float(value) if isinstance(value, (int, float)) else None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else None if value is None or isinstance(value, bytes) else str(value)
    return value if isinstance(value, bytes) else None if value is None else str(value).encode()


class Sqlite(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as db:
            rows = db.execute("SELECT name, type FROM pragma_table_info(?)", [self.options["table"]]).fetchall()
        return StructType([StructField(name, type_of(kind)) for name, kind in rows])

    def reader(self, schema: StructType) -> Reader:
        return (PushingReader if self.options.get("push") == "true" else Reader)(self.options, schema)


TABLES = "SELECT 'main' AS table_schema, name AS table_name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%'"
EACH = f"({TABLES}) t JOIN"
QUERIES = {
    "tables": (TABLES, "table_schema string, table_name string"),
    "columns": (f"SELECT t.table_name, c.name AS column_name, c.type AS data_type, CASE c.\"notnull\" WHEN 0 THEN 'YES' ELSE 'NO' END AS is_nullable, c.dflt_value AS column_default, "
                f"c.cid + 1 AS ordinal_position, c.pk FROM {EACH} pragma_table_info(t.table_name) c",
                "table_name string, column_name string, data_type string, is_nullable string, column_default string, ordinal_position long, pk long"),
    "foreign_keys": (f"SELECT t.table_name, k.\"from\" AS column_name, k.\"table\" AS referenced_table, k.\"to\" AS referenced_column FROM {EACH} pragma_foreign_key_list(t.table_name) k",
                     "table_name string, column_name string, referenced_table string, referenced_column string"),
    "indexes": (f"SELECT t.table_name, i.name AS index_name, x.name AS column_name, i.\"unique\" AS is_unique, i.origin, x.seqno AS position FROM {EACH} pragma_index_list(t.table_name) i "
                "JOIN pragma_index_info(i.name) x", "table_name string, index_name string, column_name string, is_unique long, origin string, position long"),
}


def catalog_of(spark: SparkSession, path: str, source: str) -> dict[str, DataFrame]:
    """db_tables, db_columns, db_foreign_keys and db_indexes of a file."""
    spark.dataSource.register(Sqlite)

    def rows(kind: str) -> DataFrame:
        sql, schema = QUERIES[kind]
        return spark.read.format("sqlite").schema(schema).option("path", path).option("query", sql).load()

    indexes = rows("indexes").select("table_name", "index_name", "column_name", (F.col("is_unique") == 1).alias("is_unique"), (F.col("origin") == "pk").alias("is_primary"), "position")
    return {"db_tables": catalog.tables(rows("tables"), source), "db_columns": catalog.columns(rows("columns"), rows("columns").filter("pk > 0"), source),
            "db_foreign_keys": catalog.foreign_keys(rows("foreign_keys"), source), "db_indexes": catalog.indexes(indexes, source)}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A whole table."""
    spark.dataSource.register(Sqlite)
    return spark.read.format("sqlite").option("path", path).option("table", name).load()


def has_filter(df: DataFrame) -> bool:
    """Whether Spark filters rows of the planned frame itself."""
    return bool(re.search(r"^[\s:+*()\d-]*Filter ", df._jdf.queryExecution().executedPlan().toString(), re.M))


def where(spark: SparkSession, path: str, name: str, condition: str, limit: int | None = None) -> DataFrame:
    """Rows of a table by a condition, at most so many, landed as a table of their own in the shared folder.

    As much of both as SQLite knows is part of the tasks' SQL; the cap is if no filter stays with Spark. Spark keeps what
    it has pushed into a loaded frame when that frame is planned again, so none is handed out that may be.
    """
    spark.dataSource.register(Sqlite)
    before = spark.conf.get(PUSH, "false")
    reader = spark.read.format("sqlite").option("path", path).option("table", name).option("push", "true")
    spark.conf.set(PUSH, "true")
    try:
        found = reader.load().filter(condition)
        if limit is not None:
            found = (found if has_filter(found) else reader.option("limit", limit).load().filter(condition)).limit(limit)
        return settled(found, "sqlite")
    finally:
        spark.conf.set(PUSH, before)
