"""Tables, columns and indexes of databases, from rows of their catalogs or from Spark's own catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tables(rows: DataFrame, source: str) -> DataFrame:
    """From table_schema and table_name; counts and sizes are unknown."""
    unknown = F.lit(None).cast("long")
    return rows.select(F.lit(source).alias("source_name"), F.col("table_schema").alias("schema_name"), "table_name",
                       unknown.alias("row_count"), unknown.alias("size_bytes"))


def columns(rows: DataFrame, primary_keys: DataFrame, source: str) -> DataFrame:
    """Columns, marked where (table_name, column_name) is among the primary keys."""
    keys = primary_keys.select("table_name", "column_name", F.lit(True).alias("_key")).distinct()
    return rows.join(keys, ["table_name", "column_name"], "left").select(
        F.lit(source).alias("source_name"), "table_name", "column_name", "data_type", (F.col("is_nullable") == "YES").alias("nullable"),
        F.col("column_default").alias("default_value"), F.coalesce("_key", F.lit(False)).alias("is_primary_key"), "ordinal_position")


def foreign_keys(rows: DataFrame, source: str) -> DataFrame:
    return rows.select(F.lit(source).alias("source_name"), "table_name", "column_name", "referenced_table", "referenced_column")


def indexes(rows: DataFrame, source: str, order: str = "position") -> DataFrame:
    """One row an index with its columns by order; the first column's row tells whether it is unique or primary.

    The name is what stands between the first and the second dot of table.index.
    """
    column = F.struct(F.col(order).alias("at"), "column_name", "is_unique", "is_primary")
    found = rows.groupBy("table_name", "index_name").agg(F.array_sort(F.collect_list(column)).alias("c"))
    return found.select(F.lit(source).alias("source_name"), "table_name",
                        F.split(F.concat_ws(".", "table_name", "index_name"), r"\.")[1].alias("index_name"), F.col("c.column_name").alias("columns"),
                        F.col("c")[0]["is_unique"].alias("is_unique"), F.col("c")[0]["is_primary"].alias("is_primary"))


def of_spark(spark: SparkSession, source: str, database: str = "default") -> tuple[DataFrame, DataFrame]:
    """Tables and columns of one database of the session's catalog, in the same layout."""
    found = [t for t in spark.catalog.listTables(database) if not t.isTemporary]
    cells = [(t.name, c.name, c.dataType, "YES" if c.nullable else "NO", None, i + 1)
             for t in found for i, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}"))]
    rows = spark.createDataFrame([(database, t.name) for t in found], "table_schema string, table_name string")
    cols = spark.createDataFrame(cells, "table_name string, column_name string, data_type string, is_nullable string, column_default string, ordinal_position int")
    return tables(rows, source), columns(cols, spark.createDataFrame([], "table_name string, column_name string"), source)
