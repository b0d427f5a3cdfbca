"""Exact vector search, and its fusion with text ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
MISSING_RANK = 1000


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def semantic_search(rows: DataFrame, key: str, vector: str, query: list[float], limit: int, threshold: float | None = None) -> DataFrame:
    """(key, similarity) of the nearest rows, of those at least at the threshold if there is one."""
    scored = rows.filter(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), F.lit([float(x) for x in query])).alias("similarity"))
    if threshold is not None:
        scored = scored.filter(F.col("similarity") >= threshold)
    return scored.orderBy(F.col("similarity").desc_nulls_last(), key).limit(limit)


def ranked(rows: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """(key, rank) of the best rows. The limit comes first, so that only its rows meet in one task."""
    best = rows.orderBy(F.col(by).desc_nulls_last(), key).limit(limit)
    return best.select(key, F.row_number().over(Window.orderBy(F.col(by).desc_nulls_last(), key)).cast("long").alias("rank"))


def hybrid_search(text: DataFrame, vector: DataFrame | None, key: str, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of two scored tables of (key, score): key, score, and which of them found it.

    Each side gives its best 2 * limit; a side that lacks a key ranks it 1000th.
    """
    words = ranked(text, key, "score", 2 * limit).withColumnRenamed("rank", "t")
    if vector is None:
        fused = words.select(key, (1.0 / (F.col("t") + RRF_K).cast("double")).alias("score"), F.lit("text").alias("source"))
    else:
        near = ranked(vector, key, "score", 2 * limit).withColumnRenamed("rank", "v")
        part = lambda c: 1.0 / (F.coalesce(c, F.lit(MISSING_RANK)) + RRF_K).cast("double")
        fused = words.join(near, key, "full_outer").select(
            key, (part("t") + part("v")).alias("score"),
            F.when(F.col("t").isNotNull() & F.col("v").isNotNull(), "both").when(F.col("t").isNotNull(), "text").otherwise("semantic").alias("source"))
    return fused.orderBy(F.desc("score"), key).limit(limit)


def embed_missing(issues: DataFrame, embed, batch: int = 100) -> DataFrame:
    """(issue_key, embedding) for issues that have none; embed turns a list of texts into vectors, batch by batch."""
    text = F.trim(F.concat(F.coalesce("summary", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit(""))))
    rows = issues.filter("embedding is null").select("issue_key", text.alias("text")).filter("text <> ''")

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                yield part[["issue_key"]].assign(embedding=list(embed(list(part["text"]))))

    return rows.mapInPandas(run, "issue_key string, embedding array<float>")
