"""The knowledge graph: edges from project tables, walks, and views of walks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions.text import module_name
from spindrift.session import settled, settled_parts

NODES = 200

# Link types that mean one issue holds up or causes another.
CAUSAL_LINKS = ("Blocks", "Blocked", "is blocked by", "Causes", "Cause", "is caused by")
# Edge types that explain an issue, and the origins of edges: read off the tables, inferred, added by hand.
CAUSAL_EDGES = ("root_causes", "probably_caused_by", "blocked_by", "caused_by")
STRUCTURAL, INFERRED, BY_HAND = "structural", "auto", "claude"

EDGE = ["source", "source_type", "type", "target", "target_type"]


def edges(rows: DataFrame, source: Column, source_type: str, kind: str, target: Column, target_type: str, weight: Column | None = None,
          origin: str = STRUCTURAL, unique: bool = False) -> DataFrame:
    """Distinct edges between named, typed entities, with their origin; an edge met twice keeps its largest weight.

    Only the two names are grouped by, as all else is fixed; unique rows need no grouping at all.
    """
    ends = rows.select(source.cast("string").alias("source"), target.cast("string").alias("target"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight"))
    ends = ends.filter("source is not null and target is not null")
    if weight is None:
        ends = ends.select("source", "target")
        found = (ends if unique else ends.distinct()).withColumn("weight", F.lit(1.0))
    else:
        found = ends if unique else ends.groupBy("source", "target").agg(F.max("weight").alias("weight"))
    return found.select("source", F.lit(source_type).alias("source_type"), F.lit(kind).alias("type"), "target", F.lit(target_type).alias("target_type"),
                        "weight", F.lit(origin).alias("origin"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """(_hash): hashes of the keys that rows have more than once, and of any that share a hash with another, as a small stored table."""
    hashed = rows.select(F.xxhash64(key).alias("_hash"))
    return settled(hashed.groupBy("_hash").agg(F.count("*").alias("n")).filter("n > 1").select("_hash"), "repeated")


def issue_edges(issues: DataFrame) -> DataFrame:
    """Edges that issues' own rows give; a key that repeats gives each edge once.

    Rows whose key is met once give their edges where they are; only those of repeated keys are shuffled by their key.
    """
    text, texts = (lambda c: F.col(c).cast("string")), (lambda c: F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")))
    ends = {"assignee": ("assigned_to", "developer"), "reporter": ("reported_by", "developer"), "labels": ("labeled", "label"),
            "components": ("in_component", "component"), "parent_key": ("parent_of", "issue")}
    many = ("labels", "components")
    own = issues.filter("issue_key is not null").select(text("issue_key").alias("key"), *((texts if c in many else text)(c).alias(c) for c in ends))
    again = repeated(own, "key")
    hashed = own.withColumn("_hash", F.xxhash64("key"))
    single = hashed.join(again, "_hash", "left_anti")

    def edge(key: Column, end: Column, kind: str, end_type: str) -> list[Column]:
        source, target = (end, key) if kind == "parent_of" else (key, end)
        return [source.alias("source"), F.lit("issue").alias("source_type"), F.lit(kind).alias("type"), target.alias("target"), F.lit(end_type).alias("target_type"),
                F.lit(1.0).alias("weight"), F.lit(STRUCTURAL).alias("origin")]

    def alone(c: str, kind: str, end_type: str) -> DataFrame:
        found = single.select("key", F.explode(F.array_distinct(c)).alias("end") if c in many else F.col(c).alias("end"))
        return found.filter("end is not null").select(*edge(F.col("key"), F.col("end"), kind, end_type))

    one = lambda c: (F.col(c) if c in many else F.array(c)).alias(c)
    keyed = hashed.join(again, "_hash", "left_semi").select("key", F.struct(*(one(c) for c in ends)).alias("row")).groupBy("key").agg(F.collect_list("row").alias("rows"))

    def of(c: str, kind: str, end_type: str) -> Column:
        return F.transform(F.array_distinct(F.flatten(F.col("rows").getField(c))), lambda v: F.struct(*edge(F.col("key"), v, kind, end_type)))

    together = keyed.select(F.inline(F.concat(*(of(c, *v) for c, v in ends.items())))).filter("source is not null and target is not null")
    return reduce(DataFrame.unionByName, [*(alone(c, *v) for c, v in ends.items()), together])


def commit_edges(commits: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    """Who committed for which issue, and who changed which module how often."""
    c = commits.select("hash", "author").filter("author is not null")
    for_issue = edges(refs.join(c, refs["commit_hash"] == c["hash"]), F.col("author"), "developer", "authored_commit_for", F.col("issue_key"), "issue")
    modules = files.select("commit_hash", module_name(F.col("file_path")).alias("module"))
    counts = modules.join(c, modules["commit_hash"] == c["hash"]).groupBy("author", "module").agg(F.count("*").alias("n"))
    return for_issue.unionByName(edges(counts, F.col("author"), "developer", "changed", F.col("module"), "module", F.col("n"), unique=True))


def pr_edges(prs: DataFrame, refs: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Pull requests by repository and number: what they implement, who wrote and, if asked for, reviewed them."""
    name = F.concat("repo_full_name", F.lit("#"), "pr_number")
    own = prs.withColumnRenamed("number", "pr_number")
    parts = [edges(refs, name, "pull_request", "implements", F.col("issue_key"), "issue"),
             edges(own, F.col("author"), "developer", "authored_pr", name, "pull_request")]
    if reviews is not None:
        parts.append(edges(reviews, F.col("reviewer"), "developer", "reviewed", name, "pull_request"))
    return reduce(DataFrame.unionByName, parts)


def link_edges(links: DataFrame) -> DataFrame:
    blocks = F.lower("link_type").contains("block")
    kind = F.when(blocks, "blocked_by").otherwise("root_causes")
    causal = links.filter(F.col("link_type").isin(*CAUSAL_LINKS) & F.col("source_key").isNotNull() & F.col("target_key").isNotNull())
    found = causal.select(F.col("source_key").cast("string").alias("source"), kind.alias("type"), F.col("target_key").cast("string").alias("target")).distinct()
    return found.select("source", F.lit("issue").alias("source_type"), "type", "target", F.lit("issue").alias("target_type"), F.lit(1.0).alias("weight"),
                        F.lit(INFERRED).alias("origin"))


def co_changes(files: DataFrame, commit: str = "commit_hash", path: str = "file_path", least: int = 3, limit: int = 500,
               widest: int | None = None) -> DataFrame:
    """(first, second, n): the pairs of paths most often changed by one commit.

    A commit of n files makes n * (n - 1) / 2 pairs, as the definition asks;
    widest, off by default, leaves out commits of more files than that.
    A commit's paths are brought together once, as a list, and paired from there.
    """
    rows = files.select(F.col(commit).alias("c"), F.col(path).alias("p")).filter("c is not null")
    made = rows.groupBy("c").agg(F.collect_list("p").alias("paths"), F.count("*").alias("size"))
    if widest is not None:
        made = made.filter(F.col("size") <= widest)
    pairs = made.select("paths", F.explode("paths").alias("first")).select("first", F.explode("paths").alias("second")).filter("first < second")
    counts = pairs.groupBy("first", "second").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "first", "second").limit(limit)


def co_change_edges(files: DataFrame, **options) -> DataFrame:
    """Edges between different modules; a pair of modules met again keeps the smallest count."""
    pairs = co_changes(files, **options).select(module_name(F.col("first")).alias("a"), module_name(F.col("second")).alias("b"), "n").filter("a <> b")
    return edges(pairs.groupBy("a", "b").agg(F.min("n").alias("n")), F.col("a"), "module", "co_changes", F.col("b"), "module", F.col("n"))


def within_days(probes: DataFrame, events: DataFrame, days: int = 14, most: int = 5, ties: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """For each probe (probe, at) the latest events (event_at, ...) of the days before, at most a few.

    by names columns that both sides have and that must be equal. Probes and events are ordered
    together within each hour, so an event gets its rank and a probe the number of events before it;
    the hours' offsets, one row an hour, make both global. A probe then meets just the events of
    its last few ranks, an equi-join on a unique key: work and rows are linear in both sides.
    Probes of one time have the same events: each time is looked up once, and only the events found
    are joined to all of its probes. Rows with a null time are left out.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own, other = [c for c in probes.columns if c not in by], [c for c in events.columns if c not in by]
    p, e = probes.filter("at is not null").withColumn("_at", micros("at")), events.filter("event_at is not null")
    none = [F.lit(None).cast(events.schema[c].dataType).alias(f"_tie_{c}") for c in ties]
    rows = (p.select(*by, F.col("_at").alias("_t"), F.lit(0).alias("_event")).distinct().select("*", *none)
            .unionByName(e.select(*by, micros("event_at").alias("_t"), F.lit(1).alias("_event"), *(F.col(c).alias(f"_tie_{c}") for c in ties),
                                  F.struct(*other).alias("_e")), allowMissingColumns=True)
            .withColumn("_hour", F.floor(F.col("_t") / 3_600_000_000)))
    in_hour = Window.partitionBy(*by, "_hour").orderBy("_t", "_event", *(F.desc(f"_tie_{c}") for c in ties))
    hours = rows.groupBy(*by, "_hour").agg(F.sum("_event").alias("_events"))
    earlier = Window.partitionBy(*by).orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hours.select(*by, "_hour", F.coalesce(F.sum("_events").over(earlier), F.lit(0)).alias("_offset"))
    counted = rows.withColumn("_n", F.sum("_event").over(in_hour.rowsBetween(Window.unboundedPreceding, 0)))
    same = counted["_hour"] == offsets["_hour"]
    for c in by:
        same = same & counted[c].eqNullSafe(offsets[c])
    ranked = counted.join(offsets, same).select(*(counted[c] for c in by), "_t", "_event", "_e", (F.col("_n") + F.col("_offset")).alias("_n"))
    asked = ranked.filter("_event = 0 and _n > 0").select(*by, F.col("_t").alias("_at"), F.col("_n").alias("_last"), F.explode(
        F.sequence(F.greatest(F.col("_n") - (most - 1), F.lit(1).cast("long")), F.col("_n"))).alias("_n"))
    found = asked.join(ranked.filter("_event = 1").select(*by, "_e", "_t", "_n"), [*by, "_n"]).filter(F.col("_t") > F.col("_at") - days * 86_400_000_000)
    latest = found.select(*by, "_at", "_e", (F.col("_last") - F.col("_n") + 1).cast("int").alias("place"))
    return p.join(latest, [*by, "_at"]).select(*by, *own, *(F.col("_e").getField(c).alias(c) for c in other), "place")


def all_within_days(probes: DataFrame, events: DataFrame, days: int = 14) -> DataFrame:
    """(probe, event), each once: all events (event, event_at) in the days before any time of a probe (probe, at).

    A probe's spans that overlap become one, so that no event is in two of them; spans meet events by the day, an
    equi-join whose rows are the result's but for those of a span's first and last day. Pairs go out as they are made,
    neither grouped nor shuffled; only those of events of several times may repeat, and these alone are made distinct.
    Rows with a null are left out.
    """
    day = 86_400_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    times = probes.filter("probe is not null and at is not null").select("probe", micros("at").alias("_end")).distinct()
    in_order = Window.partitionBy("probe").orderBy("_end")
    # ends are left out, so spans that only touch stay two
    starts = F.coalesce((F.lag("_end").over(in_order) <= F.col("_end") - days * day).cast("int"), F.lit(1))
    spans = times.withColumn("_new", starts).withColumn("_span", F.sum("_new").over(in_order)).groupBy("probe", "_span").agg(
        (F.min("_end") - days * day).alias("_start"), F.max("_end").alias("_end"))
    of_day = lambda c: c - F.pmod(c, F.lit(day))
    asked = spans.select("probe", "_start", "_end", F.explode(F.sequence(of_day(F.col("_start") + 1), of_day(F.col("_end") - 1), F.lit(day))).alias("_day"))
    at = events.filter("event is not null and event_at is not null").select("event", micros("event_at").alias("_t")).distinct()
    at = at.withColumn("_day", of_day(F.col("_t"))).withColumn("_hash", F.xxhash64("event"))
    again = repeated(at, "event")

    def met(found: DataFrame) -> DataFrame:
        inside = (asked["_day"] == found["_day"]) & (found["_t"] > asked["_start"]) & (found["_t"] < asked["_end"])
        return asked.join(found, inside).select("probe", "event")

    return met(at.join(again, "_hash", "left_anti")).unionByName(met(at.join(again, "_hash", "left_semi")).distinct())


def suspects(rows: DataFrame) -> DataFrame:
    """Edges from the pull requests of (issue, prs) rows to the issues, each once: an issue's arrays meet before they become edges."""
    met = rows.groupBy("issue").agg(F.collect_list("prs").alias("all"))
    pairs = met.select("issue", F.explode(F.array_distinct(F.flatten("all"))).alias("pr"))
    return edges(pairs, F.col("pr"), "pull_request", "probably_caused_by", F.col("issue"), "issue", origin=INFERRED, unique=True)


def _named_merges(prs: DataFrame) -> DataFrame:
    return prs.filter("merged_at is not null").select(F.concat("repo_full_name", F.lit("#"), "number").alias("pr"), F.col("merged_at").alias("event_at"))


def _reopened(changelogs: DataFrame) -> DataFrame:
    reopened = changelogs.filter("field = 'status' and to_value = 'Reopened' and issue_key is not null")
    return reopened.select(F.col("issue_key").alias("issue"), F.col("changed_at").alias("at"))


def before_reopenings(changelogs: DataFrame, prs: DataFrame) -> DataFrame:
    """(issue, prs): for each time that an issue was reopened the latest five pull requests merged in the two weeks before, as
    the built graph holds them; regressions() finds all."""
    reopened = _reopened(changelogs)
    latest = within_days(reopened.select("at").distinct(), _named_merges(prs), ties=("pr",)).groupBy("at").agg(F.collect_list("pr").alias("prs"))
    # stored, so that its size is known: where times are few, no reopening is shuffled to meet them
    latest = settled(latest, "latest")
    return reopened.join(latest, "at").select("issue", "prs")


def regressions(changelogs: DataFrame, prs: DataFrame) -> DataFrame:
    """All pull requests merged in the two weeks before an issue was reopened."""
    pairs = all_within_days(_reopened(changelogs).withColumnRenamed("issue", "probe"), _named_merges(prs).withColumnRenamed("pr", "event"))
    return edges(pairs, F.col("event"), "pull_request", "probably_caused_by", F.col("probe"), "issue", origin=INFERRED, unique=True)


def before_bugs(issues: DataFrame, prs: DataFrame, refs: DataFrame, asof: str) -> DataFrame:
    """(issue, prs): for each recent bug the pull requests merged in the two weeks before, for issues that share a component with it."""
    since = F.add_months(F.to_date(F.lit(asof)), -6)
    bugs = issues.filter(F.col("issue_type").isin("Bug", "Defect") & (F.col("created") >= since) & (F.size("components") > 0))
    by_component = bugs.select(F.col("issue_key").alias("bug"), F.col("created"), F.explode("components").alias("component"))
    # earlier merges meet no recent bug; a day more than the two weeks covers time zones
    merged = _named_merges(prs.filter(F.col("merged_at") > F.date_sub(since, 15)))
    linked = refs.select(F.concat("repo_full_name", F.lit("#"), "pr_number").alias("pr"), "issue_key").join(settled(merged, "merged"), "pr")
    # stored, so that their size is known: where recent merges are few, neither all references nor all issues are shuffled to meet them
    linked = settled(linked, "linked")
    touched = linked.join(issues.select("issue_key", "components"), "issue_key").select("pr", "event_at", F.explode("components").alias("component")).distinct()
    # the latest five of a bug are among the latest five of its components
    probes = by_component.select(F.col("bug").alias("probe"), F.col("created").alias("at"), "component")
    pairs = within_days(probes, touched, ties=("pr",), by=("component",)).select(F.col("probe").alias("bug"), "pr", "event_at").distinct()
    order = Window.partitionBy("bug").orderBy(F.desc("event_at"), "pr")
    latest = pairs.withColumn("_n", F.row_number().over(order)).filter("_n <= 5")
    return latest.select(F.col("bug").alias("issue"), F.array("pr").alias("prs"))


def bug_causes(issues: DataFrame, prs: DataFrame, refs: DataFrame, asof: str, known: DataFrame | None = None) -> DataFrame:
    """Edges of before_bugs(), without known ones."""
    found = suspects(before_bugs(issues, prs, refs, asof))
    return found if known is None else found.join(known.select("source", "target", "type"), ["source", "target", "type"], "left_anti")


def module_imports(rows: DataFrame) -> DataFrame:
    """Edges between the modules of (path, target) rows, importing and imported files; a module's imports of itself give none."""
    modules = rows.select(module_name(F.col("path")).alias("a"), module_name(F.col("target")).alias("b")).filter("a <> b")
    return edges(modules, F.col("a"), "module", "imports", F.col("b"), "module")


def package_edges(rows: DataFrame) -> DataFrame:
    """Edges from a project to each package of (project, package) rows."""
    return edges(rows, F.col("project"), "package", "depends_on_pkg", F.col("package"), "package")


def causal_parts(tables: dict[str, DataFrame], asof: str) -> list[DataFrame]:
    """The edges that explain issues: links, and pull requests before a reopening or a bug."""
    t = tables
    before = before_reopenings(t["issue_changelogs"], t["pull_requests"]).unionByName(before_bugs(t["issues"], t["pull_requests"], t["pr_issue_refs"], asof))
    return [link_edges(t["issue_links"]), suspects(before)]


def parts(tables: dict[str, DataFrame], asof: str, since: str | None = None, **options) -> list[DataFrame]:
    """The edges of build() in parts that share none, each a job of its own."""
    t = tables
    out = [issue_edges(changed_since(t["issues"], since)), commit_edges(t["commits"], t["commit_issue_refs"], t["commit_files"]),
           pr_edges(t["pull_requests"], t["pr_issue_refs"], t.get("pr_reviews")), co_change_edges(t["commit_files"], **options), *causal_parts(t, asof)]
    if "imports" in t:
        out.append(module_imports(t["imports"]))
    if "packages" in t:
        out.append(package_edges(t["packages"]))
    return out


def build(tables: dict[str, DataFrame], asof: str, since: str | None = None, **options) -> DataFrame:
    """All edges that the project tables imply, each once.

    tables holds issues, commits, commit_issue_refs, commit_files, pull_requests, pr_issue_refs,
    issue_links and issue_changelogs; pr_reviews where reviewers are wanted; imports (path, target) and
    packages (project, package) where source code was scanned. With since, issues not updated from then on
    give no edges of their own, for adding to a graph that holds those; all other edges come from
    all rows, as their weights and limits do. Options go to co_changes.
    """
    return reduce(DataFrame.unionByName, parts(tables, asof, since, **options))


def stored(tables: dict[str, DataFrame], asof: str, since: str | None = None, **options) -> DataFrame:
    """build() as a table in the shared folder, for plans that read it often."""
    return settled_parts(parts(tables, asof, since, **options), "graph")


def changed_since(rows: DataFrame, since: str | None, at: str = "updated") -> DataFrame:
    return rows if since is None else rows.filter(F.col(at) >= F.lit(since).cast("timestamp"))


def entities(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.col("source").alias("name"), F.col("source_type").alias("type")).union(graph.select("target", "target_type"))
    return ends.distinct()


def walk(graph: DataFrame, seeds: DataFrame, depth: int = 2, limit: int | None = NODES, kind: str | None = None) -> DataFrame:
    """(name, type, depth) of entities within so many undirected steps of the seeds, nearest first.

    A step is an equi-join of the edges' either end with the frontier, which loses what was seen before. Frontiers
    are written to the shared folder, so that each is made once and, where small, is broadcast and no edge is shuffled.
    As the nearest come first, no step is made once there are as many entities as asked for, and the last one keeps the
    first that are still missing. With kind, entities of that type alone are returned; the walk goes through all.
    """
    if kind is not None and limit:
        raise ValueError("a limit counts entities of every type")
    seen = frontier = settled(seeds.select("name", "type").distinct().withColumn("depth", F.lit(0)), "walk")
    for d in range(1, depth + 1):
        missing = limit - seen.count() if limit else None
        if missing is not None and missing <= 0:
            break
        near = frontier.select("name", "type")
        reached = (graph.select(F.col("source").alias("name"), F.col("source_type").alias("type"), F.col("target").alias("to"), F.col("target_type").alias("to_type"))
                   .join(near, ["name", "type"], "left_semi").select("to", "to_type"))
        reached = reached.union(graph.select(F.col("target").alias("name"), F.col("target_type").alias("type"), F.col("source").alias("to"), F.col("source_type").alias("to_type"))
                                .join(near, ["name", "type"], "left_semi").select("to", "to_type"))
        reached = reached.select(F.col("to").alias("name"), F.col("to_type").alias("type"))
        if d == depth and kind is not None:
            reached = reached.filter(F.col("type") == kind)
        reached = reached.join(seen, ["name", "type"], "left_anti")
        if d == depth and limit:
            reached = first_distinct(reached, missing)
        frontier = reached.distinct().withColumn("depth", F.lit(d))
        if d < depth:
            frontier = settled(frontier, "walk")
        seen = seen.unionByName(frontier)
    if kind is not None:
        return seen.filter(F.col("type") == kind)
    return seen.orderBy("depth", "type", "name").limit(limit) if limit else seen


def first_distinct(nodes: DataFrame, n: int) -> DataFrame:
    """nodes, repeats and all, without those that are surely not among the first n distinct ones by type and name.

    The nth of any n distinct nodes comes no earlier than the nth of all, so those after it are
    left out before anything is shuffled; where a first look finds fewer than n, all stay.
    """
    order = ["type", "name"]
    some = nodes.limit(50 * n).distinct().orderBy(*order).limit(n).select(*order).collect()
    if len(some) < n or any(v is None for v in some[-1]):
        return nodes
    kind, name = some[-1]
    return nodes.filter(F.col("type").isNull() | F.col("name").isNull() | (F.col("type") < kind) | ((F.col("type") == kind) & (F.col("name") <= name)))


def seeds(graph: DataFrame, part: str, nodes: DataFrame | None = None) -> DataFrame:
    """Entities with the part in their name, of a table of entities where there is one; it may hold some without edges."""
    return (entities(graph) if nodes is None else nodes.select("name", "type")).filter(F.col("name").ilike(f"%{part}%"))


def edges_of(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among the nodes; those with both once."""
    ends = lambda s: nodes.select(F.col("name").alias(s), F.col("type").alias(f"{s}_type")).distinct()
    at = lambda df, s, how: df.join(ends(s), [s, f"{s}_type"], how).select(*graph.columns)
    return at(graph, "source", "left_semi").union(at(at(graph, "target", "left_semi"), "source", "left_anti"))


def around(graph: DataFrame, part: str, depth: int, known: DataFrame | None = None) -> DataFrame:
    """The walk from what has the part in its name, written once for all that reads it."""
    return settled(walk(graph, seeds(graph, part, known), depth), "nodes")


def incident(graph: DataFrame, kind: str) -> DataFrame:
    """(name, edge type) for every end of the given entity type."""
    return graph.filter(F.col("source_type") == kind).select(F.col("source").alias("name"), F.col("type").alias("edge")).union(
        graph.filter(F.col("target_type") == kind).select("target", "type"))


def notes_on(nodes: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of the entities by name, oldest first."""
    return observations.join(nodes.select("name").distinct(), "name", "left_semi").orderBy(F.col("created_at").asc_nulls_last(), "name", "content")


def impact(graph: DataFrame, part: str, depth: int = 2, observations: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a file or module touches: entities, 20 issues, the 10 busiest developers, and what is noted on any of them."""
    nodes = around(graph, part, depth, known)
    busy = incident(edges_of(graph, nodes), "developer").groupBy("name").agg(F.count("*").alias("edges"))
    out = {"entities": nodes, "issues": nodes.filter("type = 'issue'").limit(20), "developers": busy.orderBy(F.desc("edges"), "name").limit(10)}
    return out if observations is None else out | {"observations": notes_on(nodes, observations)}


def context(graph: DataFrame, topic: str, depth: int = 2, observations: DataFrame | None = None, known: DataFrame | None = None) -> dict[str, DataFrame]:
    """Business processes and features around a topic, 15 issues, and what is noted on any entity there."""
    nodes = around(graph, topic, depth, known)
    out = {kind: nodes.filter(F.col("type") == kind) for kind in ("business_process", "feature")} | {"issue": nodes.filter("type = 'issue'").limit(15)}
    return out if observations is None else out | {"observations": notes_on(nodes, observations)}


def expertise(graph: DataFrame, area: str, limit: int = 10) -> DataFrame:
    """Developers around an area by what joins them to it."""
    return busiest(edges_of(graph, around(graph, area, 2)), limit)


def busiest(graph: DataFrame, limit: int = 10) -> DataFrame:
    """Developers by their number of edges, and how many of those are commits, reviews and assignments."""
    is_any = lambda *k: F.count_if(F.col("edge").isin(*k))
    return (incident(graph, "developer").groupBy("name").agg(F.count("*").alias("total"), is_any("authored_commit_for", "changed").alias("commits"),
                                                             is_any("reviewed").alias("reviews"), is_any("assigned_to").alias("assigned"))
            .orderBy(F.desc("total"), "name").limit(limit))


def related_issues(graph: DataFrame, key: str, depth: int = 3, limit: int | None = 30, known: DataFrame | None = None) -> DataFrame:
    """Issues within so many steps of the key, and whether an edge added by hand ends at them (semantic); with known
    entities also what these say of status and summary.

    Every step of the walk is made, through entities of all types. A limit takes the nearest, in order.
    """
    nodes = walk(graph, seeds(graph, key, known), depth, None, "issue").filter(F.col("name") != key.upper())
    by_hand = incident(graph.filter(F.col("origin") == BY_HAND), "issue").select("name").distinct()
    found = nodes.join(by_hand.withColumn("_by_hand", F.lit(True)), "name", "left").select("name", "type", "depth", F.col("_by_hand").isNotNull().alias("semantic"))
    if limit is not None:
        found = found.orderBy("depth", "name").limit(limit)
    if known is not None:
        said = known.filter("type = 'issue'").select("name", *(F.get_json_object("properties", f"$.{c}").alias(c) for c in ("status", "summary")))
        found = found.join(said, "name", "left")
        found = found if limit is None else found.orderBy("depth", "name")
    return found


def dependencies(graph: DataFrame, part: str, depth: int = 2) -> DataFrame:
    """Edges around a file or module: 15 co-changes by weight, 20 imports and 20 packages."""
    found = edges_of(graph, around(graph, part, depth)).filter(F.col("type").isin("co_changes", "imports", "depends_on_pkg"))
    place = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("weight"), "source", "target"))
    return found.withColumn("place", place).filter(F.col("place") <= F.when(F.col("type") == "co_changes", 15).otherwise(20)).drop("place")


def causes(graph: DataFrame) -> DataFrame:
    """Causal edges into issues, with how sure they are."""
    return graph.filter((F.col("target_type") == "issue") & F.col("type").isin(*CAUSAL_EDGES)).withColumn("bucket", bucket())


def root_causes(graph: DataFrame, key: str) -> DataFrame:
    return causes(graph.filter(F.col("target") == key.upper())).orderBy("type", F.desc("weight"), "source")


def bucket() -> Column:
    auto = F.col("origin") == INFERRED
    return (F.when(auto & F.col("type").isin("root_causes", "blocked_by"), "confirmed")
            .when(auto & (F.col("type") == "probably_caused_by"), "probable").when(F.col("origin") == BY_HAND, "manual"))


def stats(graph: DataFrame, nodes: DataFrame | None = None, observations: DataFrame | None = None) -> DataFrame:
    """(facet, value, n): entities by type, edges by type, and the number of observations where there is a table of them."""
    part = lambda df, f: df.groupBy(F.col("type").alias("value")).agg(F.count("*").alias("n")).select(F.lit(f).alias("facet"), "value", "n")
    out = part(entities(graph) if nodes is None else nodes, "entity").unionByName(part(graph, "edge"))
    if observations is None:
        return out
    return out.unionByName(observations.agg(F.count("*").alias("n")).select(F.lit("observation").alias("facet"), F.lit(None).cast("string").alias("value"), "n"))


def orphans(nodes: DataFrame, graph: DataFrame, observations: DataFrame | None = None) -> DataFrame:
    """Entities with no edge and no observation."""
    left = nodes.join(entities(graph), ["name", "type"], "left_anti")
    return left if observations is None else left.join(observations.select("name").distinct(), "name", "left_anti")
