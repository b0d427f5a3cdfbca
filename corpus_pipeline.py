"""A pipeline from raw documents to token ids, in stages over the whole corpus.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from spindrift.llm.common import documents, materialize, small


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep_text=True)
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stay in a later one; n_chars follows the text."""
    kept = line_dedup.drop_lines(docs)
    text = F.when(~F.col("_null"), F.col("_kept"))
    return kept.withColumns({"text": text, "n_chars": F.length(text).cast("long")}).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id (null last), of each group linked by five-word shingles at 0.8.

    Rows are known by a hash of doc_id and text, so null and repeated ids are rows like all others.
    """
    key = F.xxhash64("doc_id", "text")
    ids = docs.select("doc_id", key.alias("key"))
    found = ngram_join.jaccard_components(docs.select(key.alias("doc_id"), "text"), ngram_join.Join(5, 80, 100))
    members = ids.join(found.select(F.col("doc_id").alias("key"), "component_id").distinct(), "key")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    members = materialize(members, "near-members")
    leaders = members.groupBy("component_id").agg(first.alias("key")).select("key")
    gone = small(materialize(members.select("key").distinct().join(leaders, "key", "left_anti"), "near-copies"))
    again = small(materialize(members.groupBy("key").count().filter("count > 1").select("key"), "near-repeats"))
    kept = docs.withColumn("_key", key).join(gone.withColumnRenamed("key", "_key"), "_key", "left_anti")
    repeats = again.withColumnRenamed("key", "_key")
    once = kept.join(repeats, "_key", "left_anti").select(*docs.columns)
    return once.union(kept.join(repeats, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(bpe.encode(docs.select("doc_id", "text"), decode=True))


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("byte-pair encoding", encoded),
]

#: Trained classifiers and byte-pair merges are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
