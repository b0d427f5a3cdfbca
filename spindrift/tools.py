"""The tools by name: each takes a workspace and arguments and returns DataFrames.

Tools that only hold settings or talk to a remote service have no part here;
the rows they would send are local_issues() and modified_issues().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import sql_gate
from spindrift.operators import estimate as estimating
from spindrift.operators import graph, graph_store, lookup, postings, search, stats, store, vectors
from spindrift.session import Workspace, settled


#: The tools search by stems unless they are told otherwise.
STEMMED = {"stemmed": True}


class Tools:
    def __init__(self, workspace: Workspace):
        self.ws, self.t = workspace, workspace.table

    def query_issues(self, sql: str | None = None, **filters) -> DataFrame:
        return self.query(sql) if sql else search.query_issues(self.t("issues"), **STEMMED | filters)

    def query_commits(self, sql: str | None = None, **filters) -> DataFrame:
        return self.query(sql) if sql else search.query_commits(self.t("commits"), self.t("commit_files"), **STEMMED | filters)

    def query_prs(self, sql: str | None = None, **filters) -> DataFrame:
        return self.query(sql) if sql else search.query_prs(self.t("pull_requests"), **STEMMED | filters)

    def query_releases(self, **filters) -> DataFrame:
        return search.query_releases(self.t("releases"), **STEMMED | filters)

    def query(self, sql: str) -> DataFrame:
        """A statement over the workspace's registered views, checked to be a reading one."""
        return sql_gate.run(self.ws.spark, sql)

    db_query = query

    def get_issue(self, issue_key: str) -> dict[str, DataFrame]:
        return lookup.get_issue(self.t("issues"), self.t("issue_comments"), self.t("issue_changelogs"), issue_key)

    def issue_stats(self, project: str | None = None) -> DataFrame:
        return stats.issue_stats(self.t("issues"), project)

    def issue_commits(self, issue_key: str, repo_path: str | None = None) -> DataFrame:
        return lookup.issue_commits(self.t("commits"), self.t("commit_issue_refs"), self.t("commit_files"), issue_key, repo_path)

    def issue_prs(self, issue_key: str) -> DataFrame:
        return lookup.issue_prs(self.t("pull_requests"), self.t("pr_issue_refs"), self.t("pr_reviews"), issue_key)

    def issue_timeline(self, issue_key: str) -> DataFrame:
        mine = lambda name: self.t(name).filter(F.col("issue_key") == issue_key.upper())
        part = lambda df, at, detail: df.select("issue_key", F.col(at).alias("at"), F.col(detail).alias("detail"))
        pr = ["repo_full_name", "pr_number"]
        commits = mine("commit_issue_refs").join(self.t("commits").withColumnRenamed("hash", "commit_hash"), "commit_hash")
        prs = mine("pr_issue_refs").join(self.t("pull_requests").withColumnRenamed("number", "pr_number"), pr)
        reviews = mine("pr_issue_refs").join(self.t("pr_reviews"), pr)
        return lookup.in_order(lookup.timeline({
            "created": part(mine("issues"), "created", "summary"), "changed": part(mine("issue_changelogs"), "changed_at", "to_value"),
            "commit": part(commits, "committed_at", "message"), "pr_opened": part(prs, "created_at", "title"),
            "pr_reviewed": part(reviews, "submitted_at", "reviewer"), "pr_merged": part(prs, "merged_at", "title")}))

    def commit_stats(self, **filters) -> DataFrame:
        return stats.commit_stats(self.t("commits"), self.t("commit_files"), self.t("commit_issue_refs"), **filters)

    def hybrid_search(self, query: str, vector: list[float] | None = None, limit: int = 10, threshold: float = 0.5) -> DataFrame:
        """Issues by cover density of the query's stems, fused with the nearest vectors where one is given."""
        issues = self.t("issues")
        texts = issues.select("issue_key", F.concat_ws(" ", "summary", "description").alias("text"))
        found = postings.ranked_texts(texts, "issue_key", "text", query).select(F.col("key").alias("issue_key"), "score")
        near = None
        if vector is not None:
            near = vectors.semantic_search(issues, "issue_key", "embedding", vector, 2 * limit, threshold).withColumnRenamed("similarity", "score")
        best = vectors.hybrid_search(found, near, "issue_key", limit).withColumnRenamed("source", "found_by")
        return best.join(issues, "issue_key", "left").orderBy(F.desc("score"), "issue_key")

    def estimate(self, description: str, assignee: str, asof: str, **options) -> dict[str, DataFrame]:
        names = ("issues", "issue_links", "issue_worklogs", "issue_changelogs", "commit_issue_refs", "commits", "commit_files")
        return estimating.estimate({n: self.t(n) for n in names}, description, assignee, asof, **STEMMED | options)

    def _catalog(self):
        return [self.t(n) for n in ("db_tables", "db_columns", "db_foreign_keys", "db_indexes")]

    def db_schema(self, **filters) -> DataFrame:
        return stats.db_schema(*self._catalog(), **filters)

    def db_stats(self, source: str | None = None) -> DataFrame:
        return stats.db_stats(*self._catalog(), source=source)

    def create_issue(self, asof: str, **fields) -> DataFrame:
        """The issues with a further, local one; its key is made from the time."""
        spark, issues = self.ws.spark, self.t("issues")
        row = spark.range(1).select(F.concat(F.lit("LOCAL-"), F.unix_millis(F.lit(asof).cast("timestamp"))).alias("issue_key"),
                                    F.lit("local").alias("source"), F.lit(asof).cast("timestamp_ntz").alias("created"),
                                    *(F.lit(v).alias(k) for k, v in fields.items()))
        return issues.unionByName(row, allowMissingColumns=True)

    def update_issue(self, issue_key: str, asof: str, **fields) -> DataFrame:
        return store.update_fields(self.t("issues"), issue_key, fields, asof)

    def push(self, updates: bool = False) -> DataFrame:
        return store.modified_issues(self.t("issues")) if updates else store.local_issues(self.t("issues"))

    def impact_analysis(self, file_or_module: str, depth: int = 2) -> dict[str, DataFrame]:
        return graph.impact(self.t("graph_edges"), file_or_module, depth, self.t("graph_observations"), self.t("graph_entities"))

    def developer_expertise(self, area: str, limit: int = 10) -> DataFrame:
        return graph.expertise(self.t("graph_edges"), area, limit)

    def related_issues(self, issue_key: str, depth: int = 3) -> DataFrame:
        return graph.related_issues(self.t("graph_edges"), issue_key, depth, known=self.t("graph_entities"))

    def code_dependencies(self, file_or_module: str, depth: int = 2) -> DataFrame:
        return graph.dependencies(self.t("graph_edges"), file_or_module, depth)

    def business_context(self, topic: str, depth: int = 2) -> dict[str, DataFrame]:
        return graph.context(self.t("graph_edges"), topic, depth, self.t("graph_observations"), self.t("graph_entities"))

    def build_business_graph(self, project: str | None = None, batch_size: int = 50) -> DataFrame:
        """The first issues by key, with descriptions cut short, for annotation."""
        rows = self.t("issues")
        rows = rows.filter(F.col("project_key") == project.upper()) if project else rows
        short = F.when(F.length("description") > 200, F.concat(F.substring("description", 1, 200), F.lit("..."))).otherwise(F.col("description"))
        return rows.orderBy("issue_key").limit(batch_size).select("issue_key", "summary", short.alias("description"))

    def graph_build(self, asof: str, since: str | None = None, **options) -> dict[str, DataFrame]:
        """The graph's tables after a build: a whole one, or of what changed from since on."""
        tables = {n: self.t(n) for n in graph_store.SOURCES}
        held = graph_store.Graph(self.t("graph_edges"), self.t("graph_entities"), self.t("graph_observations"))
        found = graph_store.rebuilt(held, tables, asof, since, **options).tables()
        return found | {"graph_edges": settled(found["graph_edges"], "graph-edges")}  # so that the held table may be overwritten

    def graph_stats(self) -> DataFrame:
        return graph.stats(self.t("graph_edges"), self.t("graph_entities"), self.t("graph_observations"))

    def add_relationship(self, source: str, source_type: str, target: str, target_type: str, kind: str) -> dict[str, DataFrame]:
        """Edges and entities with one more edge, or with its weight set, and its ends; what exists keeps its origin and properties."""
        row = [(source, source_type, kind, target, target_type, 1.0, graph.BY_HAND)]
        new = self.ws.spark.createDataFrame(row, "source string, source_type string, type string, target string, target_type string, weight double, origin string")
        ends = graph.entities(new).withColumn("properties", F.lit("{}"))
        return {"graph_edges": graph_store.merge(self.t("graph_edges"), new),
                "graph_entities": store.insert_missing(self.t("graph_entities"), ends, ["name", "type"])}

    def root_cause_analysis(self, issue_key: str) -> DataFrame:
        return graph.root_causes(self.t("graph_edges"), issue_key)

    def add_observation(self, entity: str, content: str, author: str, asof: str) -> DataFrame:
        """The observations with one more; the entity must be in the graph."""
        if self.t("graph_entities").filter(F.col("name") == entity).isEmpty():
            raise KeyError(entity)
        notes = self.t("graph_observations")
        row = self.ws.spark.range(1).select(F.lit(entity).alias("name"), F.lit(content).alias("content"), F.lit(author).alias("author"),
                                            F.lit(asof).cast("timestamp_ntz").alias("created_at"))
        return notes.unionByName(row)

    def observations(self, entity: str) -> DataFrame:
        return store.observations_of(self.t("graph_observations"), entity)

    def list_projects(self) -> DataFrame:
        return search.projects(self.t("issues"))

    def switch_workspace(self, folder: str) -> Tools:
        return Tools(Workspace(self.ws.spark, folder))
