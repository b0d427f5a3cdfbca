"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

#: ASCII white space, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: Used only by a local master whose session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Whether an execution's shuffle files go when it ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a Python worker takes at a time, for bounded memory.
ROWS = 512
#: Rows of a few numbers up to which a table is broadcast (some 64 MB); past it the join shuffles.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can read, from spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_CHECKPOINTS
    raise ValueError(f"spark.checkpoint.dir is unset and {master} has no folder that all executors share")


def table_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/spindrift/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again.

    This cuts the lineage, so that a lost executor costs a reread and not a
    recomputation, and so that a table used twice is made once. Nothing reads
    the shuffle files behind a written table again; the session is told, once
    and for all, to let shuffle files go when their execution ends.
    """
    spark = df.sparkSession
    path = table_path(spark, name)
    if spark.conf.get(RELEASE) != "true":
        spark.conf.set(RELEASE, "true")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.spindrift_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing will read again."""
    for table in tables:
        remove(table.sparkSession, table.spindrift_path)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing will read again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(table) if table.count() <= rows else table


def text_of(column: str = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for each row.

    A higher-order function that only names a column may have the column's
    expression moved into its lambda, and then computes it for each element.
    A lambda's variable is bound once.
    """
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space."""
    parts = F.split(text, f"[{SPACE}]+")
    return F.filter(parts, lambda w: w != "")


def packed(docs: DataFrame, without: Sequence[str]) -> tuple[list[str], list[Column]]:
    """The other columns' names, and them as one struct _rest, whose fields clash with nothing."""
    gone = {c.lower() for c in without}
    others = [c for c in docs.columns if c.lower() not in gone]
    return others, [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_rest")] if others else []


def unpacked(others: Sequence[str]) -> list[Column]:
    return [F.col("_rest").getField(c).alias(c) for c in others]


def mapped(docs: DataFrame, inputs: dict[str, Column], run: Callable, made: str, without: Sequence[str] = ()) -> DataFrame:
    """docs with new columns from Arrow batches of the inputs.

    run takes a batch of the input columns and returns the arrays of the
    columns in the DDL made. docs' own columns of those names, and those in
    without, are left out; all others stay, whatever their names.
    """
    new = _parse_datatype_string(made)
    others, rest = packed(docs, [*new.names, *without])
    rows = docs.select(*(c.alias(k) for k, c in inputs.items()), *rest)
    n, names = len(inputs), [*new.names, *(["_rest"] if rest else [])]

    def batches(found):
        import pyarrow as pa

        for whole in found:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*run(batch), *batch.columns[n:]], names)

    schema = StructType([*new.fields, *([StructField("_rest", rows.schema["_rest"].dataType)] if rest else [])])
    return rows.mapInArrow(batches, schema).select(*new.names, *unpacked(others))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
