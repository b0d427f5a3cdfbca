"""The stored graph: edges by origin, entities with properties, observations; clearing, merging and incremental builds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.operators import graph
from spindrift.operators.store import upsert
from spindrift.session import settled

#: Tables that a build reads.
SOURCES = ("issues", "commits", "commit_issue_refs", "commit_files", "pull_requests", "pr_issue_refs", "pr_reviews", "issue_links", "issue_changelogs")
#: Edges that an issue's own row gives, by the end that names the issue.
OWN_EDGES = {"source": ("assigned_to", "reported_by", "labeled", "in_component"), "target": ("parent_of",)}


class Graph:
    """edges (source, source_type, type, target, target_type, weight, origin), entities (name, type, properties as JSON),
    and observations (name, content, author, created_at). Entities may come as a function that makes them when they are first asked for."""

    def __init__(self, edges: DataFrame, entities: DataFrame | Callable[[], DataFrame], observations: DataFrame):
        self.edges, self._entities, self.observations = edges, entities, observations

    @property
    def entities(self) -> DataFrame:
        if not isinstance(self._entities, DataFrame):
            self._entities = self._entities()
        return self._entities

    def tables(self) -> dict[str, DataFrame]:
        return {"graph_edges": self.edges, "graph_entities": self.entities, "graph_observations": self.observations}


#: What tells edges apart before any name does.
KIND = ["source_type", "type", "target_type"]


def merge(old: DataFrame, new: DataFrame, unique: bool = False) -> DataFrame:
    """Edges of both; one that is in both takes the new weight and keeps its first origin.

    Only edges of kinds that both have can be in both; all others pass without a shuffle. Where new repeats
    an edge, any one stays; unique says that it repeats none.
    """
    cols = [*graph.EDGE, "weight", "origin"]
    old, new = old.select(*cols), new.select(*cols)
    new = new if unique else new.dropDuplicates(graph.EDGE)
    kinds = lambda df: {tuple(r) for r in df.select(*KIND).distinct().collect()}
    first = kinds(old)
    shared = sorted(first & kinds(new), key=repr) if first else []
    if not shared:
        return old.unionByName(new)
    either = reduce(Column.__or__, (reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(KIND, kind))) for kind in shared))
    return old.filter(~either).unionByName(new.filter(~either)).unionByName(upsert(old.filter(either), new.filter(either), graph.EDGE, keep=("origin",)))


def cleared(held: Graph) -> Graph:
    """The graph without edges that a build makes, and without entities that then have neither edge nor observation."""
    edges = held.edges.filter(~F.col("origin").isin(graph.STRUCTURAL, graph.INFERRED))

    def kept() -> DataFrame:
        left = graph.orphans(held.entities, edges, held.observations)
        return held.entities.join(left.select("name", "type"), ["name", "type"], "left_anti")

    return Graph(edges, kept, held.observations)


def entity_rows(tables: dict[str, DataFrame], edges: DataFrame, since: str | None = None) -> DataFrame:
    """Entities of a build: issues with summary, type and status; commit authors; and all ends of its edges."""
    issues = graph.changed_since(tables["issues"], since)
    said = F.to_json(F.struct("summary", F.col("issue_type").alias("issueType"), "status"))
    own = issues.filter("issue_key is not null").select(F.col("issue_key").alias("name"), F.lit("issue").alias("type"), said.alias("properties"))
    authors = graph.changed_since(tables["commits"], since, "committed_at").filter("author is not null").select(
        F.col("author").alias("name"), F.lit("developer").alias("type"))
    others = authors.union(graph.entities(edges)).distinct().withColumn("properties", F.lit(None).cast("string"))
    rows = own.unionByName(others)
    return rows.groupBy("name", "type").agg(F.max("properties").alias("properties"))


def _unchanged(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Old edges of the rows of issues that have not changed, which an incremental build makes none of."""
    keys = changed.select("issue_key").distinct()
    out = []
    for end, kinds in OWN_EDGES.items():
        own = edges.filter((F.col("origin") == graph.STRUCTURAL) & F.col("type").isin(*kinds))
        out.append(own.join(keys, own[end] == keys["issue_key"], "left_anti"))
    return reduce(DataFrame.unionByName, out)


def rebuilt(held: Graph, tables: dict[str, DataFrame], asof: str, since: str | None = None, **options) -> Graph:
    """The graph after a build.

    A whole build clears what builds make and makes it anew. An incremental one keeps the edges of the
    rows of issues that have not changed from since on; so it equals a whole one, as long as each change
    of an issue moves its updated time. Manual edges, noted entities and observations stay in both. Entities
    that lost their last edge go in both. Properties of entities that a build knows no more about stay.
    The new edges are written to the shared folder once, a part after another; the graph's edges are a plan over
    them and the held ones, and its entities are made and written when they are first asked for.
    """
    fresh = graph.stored(tables, asof, since, **options)
    base = cleared(held)
    merged = merge(base.edges, fresh, unique=True)
    if since is not None:
        merged = merged.unionByName(_unchanged(held.edges, graph.changed_since(tables["issues"], since)).select(*merged.columns))

    def made() -> DataFrame:
        nodes = base.entities if since is None else held.entities
        new = entity_rows(tables, fresh, since)
        known = nodes.select("name", "type", F.col("properties").alias("_before"))
        joined = known.join(new, ["name", "type"], "full_outer")
        rows = joined.select("name", "type", F.coalesce("properties", "_before", F.lit("{}")).alias("properties"))
        # what a build names stays even without an edge: an issue or an author by itself
        standing = graph.entities(merged).union(held.observations.join(nodes, "name").select("name", "type"))
        if since is not None:
            own = tables["issues"].select(F.col("issue_key").alias("name"), F.lit("issue").alias("type"))
            standing = standing.union(own).union(tables["commits"].select(F.col("author").alias("name"), F.lit("developer").alias("type")))
        else:
            standing = standing.union(new.select("name", "type"))
        stay = rows.join(standing.distinct(), ["name", "type"], "left_semi").select("name", "type", "properties")
        return settled(stay, "graph-entities")

    return Graph(merged, made, held.observations)


def empty(spark) -> Graph:
    """An empty graph."""
    edge = "source string, source_type string, type string, target string, target_type string, weight double, origin string"
    return Graph(spark.createDataFrame([], edge), spark.createDataFrame([], "name string, type string, properties string"),
                 spark.createDataFrame([], "name string, content string, author string, created_at timestamp_ntz"))
