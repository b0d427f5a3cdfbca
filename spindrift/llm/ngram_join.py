"""N-gram Jaccard join with several global token orders.

Documents are linked if the Jaccard similarity of their sets of word shingles
reaches a threshold. Equal sets are first collapsed into one class. Under any
one order of all tokens, two linked sets share a token among the first
n - ceil(t n) + 1 of each; candidates must do so under three orders:

1. Tokens whose hash is in the lowest part of the hash space come first, the
   rarest first, and then all others by hash. Frequencies are counted over all
   classes. Rare tokens first keeps passages that many documents share out of
   the prefixes. The places of a pair's first common token also bound its
   overlap from above, and whole groups whose least place is too high go.
2. and 3. Two other hashes of the token.

Within the group of a token the class with the least place, which has the
fewest tokens of its own, meets all others; pairs that pass the filters are
verified, and verified links are merged into components. Groups that are then
still in several components are done again under a first order that ranks all
their tokens, not only a part of the hash space, by frequency. There the
places are as good as exact. What is still open then, near copies just below
the threshold, is compared block by block inside tasks that return links
only. No pairs of a group are written, and no link between components is lost.

Defined results: null and empty texts, and texts of white space, have the
empty set and are linked with nothing; fewer words than a shingle make one
shingle of all; null doc_ids get no component of their own and null as
result; repeated doc_ids count as one document for each different set and
share a component; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, documents, mapped, materialize, small
from spindrift.llm.components import components
from spindrift.llm.shingling import LOWER, arrays, binary_texts, lists, mixed, shingle_set, word_hashes

#: Classes of a cluster that one block holds.
BLOCK = 256


@dataclass(frozen=True)
class Join:
    """width words to a shingle; linked at an intersection of at least num / den of the union."""

    width: int = 5
    num: int = 80
    den: int = 100

    def prefix(self, n: Column) -> Column:
        """How many first tokens of n must share one with any linked set's."""
        return n - F.ceil(n * self.num / self.den) + 1

    def prefix_of(self, n: int) -> int:
        return n + (-n * self.num) // self.den + 1

    @property
    def low(self) -> int:
        """Hashes below this come first in the first order: 1.5 times a prefix's share."""
        return int(-(2**63) + 2**64 * 1.5 * (1 - self.num / self.den))

    def sizes_fit(self, n: Column, m: Column) -> Column:
        return F.least(n, m) * self.den >= F.greatest(n, m) * self.num

    def places_fit(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """Whether sets of n and m tokens with their first common one in places i and j may be linked."""
        most = F.least(n - i, m - j)
        return most * self.den >= (most + i + j) * self.num

    def linked(self, shared: Column, n: Column, m: Column) -> Column:
        return shared * self.den >= (n + m - shared) * self.num


def with_sets(docs: DataFrame, join: Join, made: str, columns) -> DataFrame:
    """docs with columns of the DDL made in place of text, by columns() from a list of token sets."""
    width = join.width

    def run(batch):
        return columns([shingle_set(word_hashes(t.translate(LOWER)), width) for t in binary_texts(batch.column(0))])

    return mapped(docs, {"text": F.col("text")}, run, made, without=["text"])


def token_sets(docs: DataFrame, join: Join) -> DataFrame:
    """docs with tokens, the sorted hashes of the text's distinct shingles."""
    return with_sets(docs, join, "tokens array<long>", lambda sets: [lists(sets)])


def other_order(tokens: np.ndarray, seed: int, length: int) -> np.ndarray:
    """The first tokens, as ranked by another hash."""
    return np.sort(mixed(tokens, seed))[:length]


def document_sets(docs: DataFrame, join: Join) -> DataFrame:
    """doc_id, n, h1 and h2 (a hash of the set), first (the tokens that can be in a prefix) and how many of them are low."""

    def columns(sets):
        import xxhash

        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t.tobytes()) for t in sets), "<i8").reshape(-1, 2)
        low = [int(np.searchsorted(t, join.low)) for t in sets]
        first = [t[:max(k, join.prefix_of(len(t)))] for t, k in zip(sets, low)]
        return [pa.array([len(t) for t in sets], pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()),
                pa.array(low, pa.int32()), lists(first)]

    return materialize(with_sets(docs, join, "n int, h1 long, h2 long, n_low int, first array<long>", columns), "join-sets")


def classes(rows: DataFrame) -> DataFrame:
    """One row for each set with tokens: h1, h2, n, n_low, first and rep, the least doc_id with it."""
    return (rows.filter("n > 0 and doc_id is not null").groupBy("h1", "h2", "n", "n_low")
            .agg(F.min("doc_id").alias("rep"), F.first("first").alias("first")))


def able(n: Column, join: Join) -> Column:
    """Whether one token more or one less leaves a set linked; smaller sets are linked with equal ones only."""
    return ((n + 1) * join.num <= n * join.den) | (n * join.num <= (n - 1) * join.den)


def postings(own: DataFrame, join: Join) -> DataFrame:
    """token, rep, n and place of the prefix tokens, in the first order, that several classes have.

    own has rep, h1 (to tell sets of one rep apart), n, first and n_low. The first n_low tokens of
    first are ranked by how many classes have them; those after them keep their place.
    """
    last = F.lit(2**62)
    flat = own.select("rep", "h1", "n", "n_low", F.posexplode("first").alias("pos", "token"))
    common = own.select(F.explode("first").alias("token")).groupBy("token").agg(F.count("*").alias("classes")).filter("classes > 1")
    ranked = F.struct(F.when(F.col("pos") < F.col("n_low"), F.col("classes")).otherwise(last).alias("rank"), "token", "pos")
    shared = flat.join(common, "token").groupBy("rep", "h1", "n", "n_low").agg(F.array_sort(F.collect_list(ranked)).alias("shared"))
    # a class's tokens that no other has come before its shared ones
    alone = F.col("n_low") - F.size(F.filter("shared", lambda s: s["rank"] < last))
    # alone is computed before the explosion, whose rows must not hold the whole list
    rows = shared.select("rep", "n", alone.alias("alone"), "shared").select("rep", "n", "alone", F.posexplode("shared").alias("k", "s"))
    place = F.when(F.col("s.rank") < last, F.col("alone") + F.col("k")).otherwise(F.col("s.pos"))
    return (rows.select(F.col("s.token").alias("token"), "rep", "n", place.cast("long").alias("place"))
            .filter(F.col("place") < join.prefix(F.col("n"))))


def near_rows(own: DataFrame, join: Join) -> DataFrame:
    """The postings that can be half of a linked pair, with hub, the row with the least place of their token."""
    found = materialize(postings(own, join), "join-postings")
    best = (found.groupBy("token").agg(F.min(F.struct("place", "n", "rep")).alias("hub"), F.count("*").alias("rows"))
            .filter("rows > 1"))
    fits = join.places_fit(F.col("n"), F.col("place"), F.col("n") * 2, F.col("hub.place"))
    near = found.join(best, "token").filter((F.col("rep") == F.col("hub.rep")) | fits).select("token", "rep", "n", "place", "hub")
    near = materialize(near, "join-near")
    discard(found)
    return near


def with_hub(near: DataFrame, join: Join) -> DataFrame:
    """Candidates (u, v) of each token's hub with all others."""
    fits = (join.sizes_fit(F.col("n"), F.col("hub.n"))
            & join.places_fit(F.col("n"), F.col("place"), F.col("hub.n"), F.col("hub.place")))
    return (near.filter((F.col("rep") != F.col("hub.rep")) & fits)
            .select(F.least("rep", "hub.rep").alias("u"), F.greatest("rep", "hub.rep").alias("v")).distinct())


def unsettled(near: DataFrame, links: DataFrame) -> DataFrame:
    """near with part, the component by the links so far, for tokens whose rows are in several parts."""
    parts = small(components(links)).withColumnRenamed("id", "rep")
    marked = near.join(parts, "rep", "left").select("token", "rep", "n", "place", F.coalesce("component", "rep").alias("part"))
    marked = materialize(marked, "join-marked")
    mixed_tokens = marked.groupBy("token").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("token")
    return marked.join(small(materialize(mixed_tokens, "join-mixed")), "token", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """The pairs (u, v) of representatives that share prefix tokens in the other orders and are linked."""
    ids = materialize(pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct(), "join-ids")
    chosen = docs.filter("doc_id is not null").join(small(ids), "doc_id")

    def columns(sets):
        first = lambda seed: lists([other_order(t, seed, join.prefix_of(len(t))) for t in sets])
        return [lists(sets), first(2), first(3)]

    sets = materialize(with_sets(chosen, join, "tokens array<long>, second array<long>, third array<long>", columns), "join-tokens")
    filters = sets.select("doc_id", "second", "third")
    a, b = filters.alias("a"), filters.alias("b")
    passed = (pairs.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id"))
              .filter(F.arrays_overlap("a.second", "b.second") & F.arrays_overlap("a.third", "b.third")).select("u", "v").distinct())
    a, b = sets.select("doc_id", "tokens").alias("a"), sets.select("doc_id", "tokens").alias("b")
    shared = F.size(F.array_intersect("a.tokens", "b.tokens"))
    links = materialize(passed.join(a, F.col("u") == F.col("a.doc_id")).join(b, F.col("v") == F.col("b.doc_id"))
                        .filter(join.linked(shared, F.size("a.tokens"), F.size("b.tokens"))).select("u", "v").distinct(), "join-links")
    discard(ids, sets)
    return links


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two of the sets share."""
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared, step = np.zeros((len(sets), len(sets)), np.float32), 4096
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    for low in range(0, int(ids[-1]) + 1, step):
        a, b = np.searchsorted(ids, [low, low + step])
        part = np.zeros((len(sets), step), np.float32)
        part[rows[a:b], ids[a:b] - low] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _links_in_block(join: Join):
    def found(table: pa.Table) -> pa.Table:
        reps, parts, blocks = (table[c].to_numpy() for c in ("rep", "part", "block"))
        sets = arrays(table["tokens"])
        n = np.array([len(x) for x in sets])
        one_block = table["i"][0].as_py() == table["j"][0].as_py()
        ok = (reps[:, None] < reps[None]) & (parts[:, None] != parts[None])
        ok &= np.minimum(n[:, None], n[None]) * join.den >= np.maximum(n[:, None], n[None]) * join.num
        if not one_block:
            ok &= blocks[:, None] != blocks[None]
        for seed in (2, 3):
            if ok.any():
                ok &= _common([other_order(x, seed, join.prefix_of(len(x))) for x in sets]) > 0
        u, v = np.nonzero(ok)
        if len(u):
            shared = _common(sets)[u, v]
            linked = shared * join.den >= (n[u] + n[v] - shared) * join.num
            u, v = u[linked], v[linked]
        return pa.table({"u": pa.array(reps[u], pa.int64()), "v": pa.array(reps[v], pa.int64())})
    return found


def block_links(rest: DataFrame, docs: DataFrame, join: Join) -> DataFrame:
    """All links between the parts of rest (token, rep, part).

    Classes that share tokens make a cluster; a cluster is dealt into blocks
    of about BLOCK classes, and every two blocks meet in one task, which
    filters by the other orders, verifies, and returns links only.
    """
    least = rest.groupBy("token").agg(F.min("rep").alias("least"))
    near = rest.join(least, "token").select(F.col("least").alias("u"), F.col("rep").alias("v")).distinct()
    clusters = components(near).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    clusters = materialize(clusters, "join-clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    members = materialize(rest.select("rep", "part").distinct().join(clusters, "rep").join(sizes, "cluster")
                          .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))), "join-members")
    sets = token_sets(docs.select(F.col("doc_id").alias("rep"), "text").join(small(members), "rep"), join)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    pairs = sets.select("rep", "part", "cluster", "block", "tokens", other).select(
        "rep", "part", "cluster", "block", "tokens", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return (pairs.groupBy("cluster", "i", "j").applyInArrow(_links_in_block(join), "u long, v long").distinct())


def _open_links(docs: DataFrame, open_ids: DataFrame, met: DataFrame, links: DataFrame, join: Join) -> DataFrame:
    """Links among the classes left open, but for pairs that have met."""
    own = token_sets(docs.join(small(open_ids), "doc_id").select(F.col("doc_id").alias("rep"), "text"), join)
    own = own.select("rep", F.xxhash64("tokens").alias("h1"), F.size("tokens").alias("n"), F.size("tokens").alias("n_low"), F.col("tokens").alias("first"))
    own = materialize(own.dropDuplicates(["rep", "h1"]), "join-own")
    near = near_rows(own, join)
    discard(own)
    again = materialize(with_hub(near, join).join(small(met), ["u", "v"], "left_anti"), "join-met")
    more = verified(again, docs, join)
    rest = materialize(unsettled(near, links.union(more)), "join-rest")
    discard(near, again)
    return more if rest.isEmpty() else more.union(block_links(rest, docs, join))


def jaccard_components(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = document_sets(docs, join)
    own = materialize(classes(rows), "join-classes")
    near = near_rows(own.filter(able(F.col("n"), join)), join)
    met = materialize(with_hub(near, join), "join-met")
    links = verified(met, docs, join)
    # tokens with a row that is not linked to their hub are ranked anew, with all tokens counted among what is left open
    known = links.select(F.col("u").alias("a"), F.col("v").alias("b"))
    ends = [F.least("rep", "hub.rep") == F.col("a"), F.greatest("rep", "hub.rep") == F.col("b")]
    tokens = materialize(near.filter(F.col("rep") != F.col("hub.rep")).join(small(known), ends, "left_anti").select("token").distinct(), "join-open-tokens")
    open_ids = materialize(near.join(small(tokens), "token", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "join-open")
    discard(near, tokens)
    if not open_ids.isEmpty():
        links = links.union(_open_links(docs, open_ids, met, links, join))
    same = (rows.filter("n > 0").join(own.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"]).filter("doc_id <> rep")
            .select(F.col("rep").alias("u"), F.col("doc_id").alias("v")))
    parts = components(links.union(same))
    discard(met, own, open_ids)
    return (rows.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir), Join(3, 90, 100))
