"""Approximate nearest neighbours by multi-index hashing.

Vectors are rotated by learned rotations (principal axes, then alternating
between signs and the best rotation to them) and their signs are packed into
128-bit codes. A code is cut into 16 bytes, each with an index of its own. A
code within Hamming radius r of a query's agrees with it, in some byte, up to
r // 16 bits; probing all bytes' indexes with that allowance finds every code
within the radius. Those codes are reranked by the original vectors in double
precision.

The index is dealt into blocks of bounded size, each with its own 16 byte
indexes, and queries meet it in blocks: a task holds one block of each and
returns the best k for each query, which are merged by query. Equal vectors
are indexed once with the k + 1 smallest ids, as no more can be in a result,
so a vector that a third of all rows share is one entry.

Rotations are fitted on ``sample`` vectors chosen by a hash; the first radius
is the one that holds all but 2 % of the exact neighbours of ``calibration``
distinct query vectors, chosen by id, which are compared with every row.
Queries that find fewer than k within it are asked again by the same index
with twice the radius, until they have k or the radius is all bits.

Defined results: vectors that are null, zero, of another length than most,
or hold null or non-finite components take no part; rows with a null
id neither; a repeated id counts once for each distinct vector; ties go to
the smaller id; with fewer candidates than k all are returned; an empty table
gives an empty result; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import materialize

K = 20
#: Vectors that the rotations are fitted on, at most about this many.
SAMPLE = 4000
#: Queries whose exact neighbours set the radius.
CALIBRATION = 128
#: Share of those queries' exact neighbours that the radius holds.
HELD = 0.98
BYTES = 16
#: Distinct vectors and queries that one task holds.
BLOCK = 16_384
QUERIES = 1_024
SPLIT = 16

FOUND = "query_id long, vec_id long, score double, far int"
BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part, with _hash of the embedding."""
    v = F.col("embedding")
    fine = (F.col("vec_id").isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
            & F.exists(v, lambda x: x != 0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(F.coalesce(fine, F.lit(False)))
    return rows.withColumn("_hash", F.xxhash64("embedding"))


def commonest_length(rows: DataFrame) -> int:
    """The length that most vectors have, the smallest of several; 0 if there are none."""
    row = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return row.n if row else 0


def learn(sample: np.ndarray, n_bits: int = 8 * BYTES, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Directions, as columns, whose signs make the code: stacked learned rotations."""
    rng = np.random.default_rng(seed)
    sample = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    axes = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    low = sample @ axes
    parts, width = [], 0
    while width < n_bits:
        turn = np.linalg.qr(rng.normal(size=(low.shape[1], low.shape[1])))[0]
        for _ in range(rounds):
            signs = np.where(low @ turn >= 0, 1.0, -1.0)
            u, _, vt = np.linalg.svd(signs.T @ low)
            turn = (u @ vt).T
        parts.append(axes @ turn)
        width += low.shape[1]
    return np.concatenate(parts, 1)[:, :n_bits]


def codes_of(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.packbits(vectors @ directions >= 0, axis=1)


class MultiIndex:
    """One block of codes with an index for each of their bytes."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.wide = codes.view(np.uint64)
        self.order = [np.argsort(codes[:, b], kind="stable") for b in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, b], np.arange(257)) for b, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of all codes within the radius, and their distances."""
        allowed = radius // len(code)
        near = np.zeros(len(self.codes), bool)
        for b, value in enumerate(code):
            for other in np.flatnonzero(BITS[np.arange(256) ^ int(value)] <= allowed):
                near[self.order[b][self.starts[b][other]:self.starts[b][other + 1]]] = True
            if near.all():
                break
        rows = np.flatnonzero(near)
        far = np.bitwise_count(self.wide[rows] ^ code.view(np.uint64)).sum(1)
        inside = far <= radius
        return rows[inside], far[inside]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _search(directions: np.ndarray, radius: int | None, k: int):
    """The best k of a block for each of a block of queries; all rows compared if there is no radius."""

    def search(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "far": []}
        if index.num_rows and queries.num_rows:
            vectors, asked = _matrix(index["embedding"]), _matrix(queries["embedding"])
            codes, asked_codes = codes_of(vectors, directions), codes_of(asked, directions)
            lookup = MultiIndex(codes)
            ids = index["ids"].to_pylist()
            for query_id, query, code in zip(queries["vec_id"].to_pylist(), asked, asked_codes):
                if radius is None:
                    rows = np.arange(len(vectors))
                    far = np.bitwise_count(lookup.wide ^ code.view(np.uint64)).sum(1)
                else:
                    rows, far = lookup.within(code, radius)
                scores = vectors[rows] @ query
                if len(rows) > k + 1:
                    floor = np.partition(scores, -k - 1)[-k - 1]
                    keep = scores >= floor - 1e-9 * abs(floor)
                    rows, far, scores = rows[keep], far[keep], scores[keep]
                best = sorted((-float(np.dot(vectors[r], query)), i, int(f)) for r, f in zip(rows, far) for i in ids[r] if i != query_id)[:k]
                out["query_id"] += [query_id] * len(best)
                out["vec_id"] += [b[1] for b in best]
                out["score"] += [-b[0] for b in best]
                out["far"] += [b[2] for b in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()),
                         "score": pa.array(out["score"], pa.float64()), "far": pa.array(out["far"], pa.int32())})

    return search


def distinct_vectors(rows: DataFrame, k: int = K) -> DataFrame:
    """embedding and ids, the k + 1 smallest, of each distinct vector.

    Ranked within 16 parts of each vector's rows first, so that the rows of a
    common vector meet in no one task.
    """
    part = F.pmod(F.xxhash64("vec_id"), F.lit(SPLIT))
    once = rows.withColumn("_part", part).withColumn("_n", F.dense_rank().over(
        Window.partitionBy("_hash", "embedding", "_part").orderBy("vec_id"))).filter(F.col("_n") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    return once.groupBy("_hash", "embedding").agg(ids.alias("ids")).select("_hash", "embedding", "ids")


def _meet(index: DataFrame, queries: DataFrame, blocks: int, query_blocks: int, search) -> DataFrame:
    """Every block of the index with every block of queries, one task for each pair."""
    left = (index.withColumn("block", F.pmod("_hash", F.lit(blocks)))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))))
    right = (queries.withColumn("part", F.pmod(F.xxhash64("vec_id", "_hash"), F.lit(query_blocks)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    return (left.select("block", "part", "embedding", "ids").groupBy("block", "part")
            .cogroup(right.select("block", "part", "vec_id", "embedding").groupBy("block", "part"))
            .applyInArrow(search, FOUND))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query, nearest first."""
    rows = usable(vectors)
    length = F.lit(commonest_length(rows))
    index = materialize(distinct_vectors(rows.filter(F.size("embedding") == length), k), "nearest-index")
    asked = usable(queries).filter(F.size("embedding") == length)
    n, n_queries = index.count(), asked.count()
    if not n or not n_queries:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share = lambda size, of: F.shiftrightunsigned(F.xxhash64(F.lit(3), "_hash"), 33) < F.lit(int(2**31 * min(1.0, size / of)))
    picked = index.filter(share(sample, n)).select("embedding").limit(2 * sample).collect()
    picked = picked or index.select("embedding").limit(1).collect()
    directions = learn(np.array(sorted(r[0] for r in picked)))
    blocks, query_blocks = -(-n // BLOCK), -(-n_queries // QUERIES)
    once = materialize(asked.groupBy("_hash", "embedding").agg(F.min("vec_id").alias("vec_id")), "nearest-queries")
    one_in = min(1.0, calibration / max(1, once.count()))
    trial = once.filter(F.shiftrightunsigned(F.xxhash64(F.lit(3), "vec_id"), 33) < F.lit(int(2**31 * one_in))).orderBy("vec_id").limit(2 * calibration)
    exact = _top(_meet(index, trial, blocks, 1, _search(directions, None, k)), k)
    radius = exact.select(F.percentile_approx("far", HELD, 1000)).first()[0]
    radius = radius if radius is not None else 8 * BYTES
    found = materialize(_top(_meet(index, asked, blocks, query_blocks, _search(directions, radius, k)), k), "nearest-found")
    while radius < 8 * BYTES:
        enough = found.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
        short = materialize(asked.join(enough, "vec_id", "left_anti"), "nearest-short")
        n_short = short.count()
        if not n_short:
            break
        radius = min(8 * BYTES, 2 * max(radius, BYTES // 2))
        wider = _top(_meet(index, short, blocks, -(-n_short // QUERIES), _search(directions, radius, k)), k)
        kept = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti")
        found = materialize(kept.unionByName(wider), "nearest-found")
    return found.drop("far")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.min("far").alias("far"))
    return (once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", "far"))


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"))
