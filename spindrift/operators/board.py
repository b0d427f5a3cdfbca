"""Boards: tasks by column, files that become tasks, the pipeline of columns, and which cards are shown where."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.store import insert_missing

# Columns with a meaning of their own, the column of each task folder, and the seconds of the units that ages are given in.
BACKLOG, DONE = "backlog", "done"
FOLDERS = {"Backlog": BACKLOG, "ToDo": BACKLOG, "Done": DONE}
UNITS = {"hours": 3600, "days": 86_400, "months": 30 * 86_400}


def in_order(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(F.col("created_at").asc_nulls_last(), "md_path")


def by_column(tasks: DataFrame, column: str) -> DataFrame:
    """A column's tasks, oldest first."""
    return in_order(tasks.filter(F.col("column_name") == column))


def column_of(folder: Column, named: Column) -> Column:
    """A file's column: what it says itself, or what its folder means."""
    known = F.create_map(*(F.lit(x) for pair in FOLDERS.items() for x in pair))
    return F.coalesce(named, F.try_element_at(known, folder), F.lit(BACKLOG))


def synced(tasks: DataFrame, files: DataFrame, asof: str) -> DataFrame:
    """tasks and those files (md_path, folder, title, named_column, jira_key, assignee) of known folders that are no task yet."""
    now = F.lit(asof).cast("timestamp_ntz")
    rows = files.filter(F.col("folder").isin(*FOLDERS)).select(
        "md_path", "title", column_of(F.col("folder"), F.col("named_column")).alias("column_name"), "jira_key", "assignee",
        now.alias("created_at"), now.alias("updated_at"))
    return insert_missing(tasks.select(*rows.columns), rows, ["md_path"])


def pipeline(columns: DataFrame, skills: DataFrame) -> DataFrame:
    """(place, name, type) with a column for each skill (place, name) that has none, in their order, before the last column.

    Both tables are small. Without columns the skills are all there is.
    """
    last = columns.agg(F.max("place").alias("_last"))
    here = columns.join(F.broadcast(last)).select(F.when(F.col("place") == F.col("_last"), 2).otherwise(0).alias("_part"), "place", "name", "type")
    missing = skills.join(columns.select("name"), "name", "left_anti").groupBy("name").agg(F.min("place").alias("place"))
    rows = here.unionByName(missing.select(F.lit(1).alias("_part"), "place", "name", F.lit("skill").alias("type")))
    return rows.select(F.row_number().over(Window.orderBy("_part", "place", "name")).cast("long").alias("place"), "name", "type")


def reordered(columns: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in that order; names of no column and columns without a name there go."""
    order = F.array_position(F.array(*map(F.lit, names)), F.col("name")) if names else F.lit(0)
    return columns.withColumn("place", order.cast("long")).filter("place > 0")


def following(columns: DataFrame) -> DataFrame:
    """(name, next) of each column; null after the last."""
    return columns.select("name", F.lead("name").over(Window.orderBy("place")).alias("next"))


def shown(cards: DataFrame, columns: DataFrame, asof: str, epic: str | None = None, skills: Sequence[str] | None = None,
          done_value: float = 0, done_unit: str = "hours") -> DataFrame:
    """Cards with shown_in, the column that shows them; those that none shows are left out.

    A workflow shows system columns and those of its skills. Cards of other columns, or none, stand in the
    backlog. With a done value other than 0, done cards are shown only if updated within so many units.
    """
    if epic:
        cards = cards.filter(F.col("epic") == epic)
    if skills is not None:
        columns = columns.filter((F.col("type") == "system") | F.col("name").isin(*skills))
    names = F.broadcast(columns.select(F.col("name").alias("shown_in")).distinct())
    rows = cards.join(names, cards["column_name"] == names["shown_in"], "left").withColumn("shown_in", F.coalesce("shown_in", F.lit(BACKLOG)))
    if done_value:
        seconds = done_value * UNITS.get(done_unit, UNITS["hours"])
        fresh = F.col("updated_at") >= F.lit(asof).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(seconds))
        rows = rows.filter((F.col("shown_in") != DONE) | F.coalesce(fresh, F.lit(False)))
    has_backlog = columns.filter(F.col("name") == BACKLOG).select(F.col("name").alias("shown_in"))
    return rows.join(F.broadcast(names.union(has_backlog).distinct()), "shown_in", "left_semi").select(*cards.columns, "shown_in")
