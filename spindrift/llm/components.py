"""Connected components by alternating stars.

Each round joins every node's larger neighbours to the least node it sees, and
then its smaller ones; components become stars in few rounds. A round is two
aggregations and two joins over the links, written to the shared folder, so no
round recomputes another; the driver learns only whether all are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """links go from a greater u to a smaller v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return (links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct())


def _are_stars(links: DataFrame) -> bool:
    """Whether every node has one link down, to a node that has none."""
    once = links.groupBy("u").agg(F.count("*").alias("n"))
    roots = links.select(F.col("v").alias("u")).distinct()
    return once.filter("n > 1").isEmpty() and once.join(roots, "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(u, v) links of long ids to (id, component), component being the least id reachable.

    Only linked ids are listed; null ends and links of an id to itself are no links.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
    links = materialize(links.distinct(), "links")
    while not _are_stars(links):
        before, links = links, materialize(_small_star(_large_star(links)), "links")
        discard(before)
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
