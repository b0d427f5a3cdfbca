"""A positional inverted index, kept as Parquet in buckets by stem, and cover-density ranks from it.

A posting says where in a document a stem stands. An index is a folder of
generations: the first holds all documents, further ones hold the documents
that have changed since. Within one, postings lie in folders by a hash of
the stem, sorted by it, so that a search reads its terms' folders only. A
document's postings count where no later generation names it; those lists of names
are small, and the first generation's is never read. A generation can be seen
once its marker, which is written last, is there; two writers of the same
number cannot both place it.

Words have positions in the whole text; stop words take a position and no posting.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.stemming import stem
from spindrift.functions.text import STOP_WORDS
from spindrift.operators import commits

BUCKETS = 64
#: Parts that a bucket is dealt over when it is written, so that a frequent stem is not one task.
PARTS = 4
#: Weight of a cover without other words in it.
COVER = 0.1
ROWS = 20_000


def terms_of(query: str, stemmed: bool = True) -> list[str]:
    """Distinct terms of a query, in order; none for stop words alone."""
    words = [w for w in re.split("[^a-z0-9]+", query.lower()) if w and w not in STOP_WORDS]
    return sorted({stem(w) if stemmed else w for w in words})


def postings(docs: DataFrame, key: str, text: str, stemmed: bool = True, only: list[str] | None = None) -> DataFrame:
    """(key, stem, positions, words) of each document's stems, or of some stems only; words is the text's length in words.

    Every distinct word is stemmed once in each worker. A null key or text gives no rows.
    """
    stops = frozenset(STOP_WORDS)
    wanted = None if only is None else frozenset(only)
    key_type = docs.schema[key].dataType

    def run(batches):
        split = re.compile("[^a-z0-9]+").split
        to_stem: Callable = lru_cache(1 << 16)(stem) if stemmed else (lambda w: w)
        for batch in batches:
            keys, stems, places, sizes = [], [], [], []
            for k, value in zip(batch.column(0), batch.column(1)):
                found: dict[str, list[int]] = {}
                words = [w for w in split(value.as_py().lower()) if w]
                for i, word in enumerate(words):
                    if word not in stops:
                        term = to_stem(word)
                        if wanted is None or term in wanted:
                            found.setdefault(term, []).append(i)
                keys += [k] * len(found)
                stems += found
                places += found.values()
                sizes += [len(words)] * len(found)
                if len(keys) >= ROWS:
                    yield rows(batch, keys, stems, places, sizes)
                    keys, stems, places, sizes = [], [], [], []
            yield rows(batch, keys, stems, places, sizes)

    def rows(batch, keys, stems, places, sizes):
        kinds = (batch.schema.field(0).type, pa.string(), pa.list_(pa.int32()), pa.int32())
        values = ([k.as_py() for k in keys], stems, places, sizes)
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], ["key", "stem", "positions", "words"])

    rest = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rest.mapInArrow(run, f"key {key_type.simpleString()}, stem string, positions array<int>, words int")


def cover_density(occurrences: Column, n_terms: int) -> Column:
    """Of sorted (position, term) pairs, terms numbered from 0: the sum over minimal covers of COVER / (1 + other words in the cover).

    A cover is a stretch of text with all terms and no shorter stretch with all of them inside. One pass holds each
    term's last place; the earliest of those begins the shortest cover that ends here, which is minimal when it begins later than the one before.
    """
    start = F.struct(F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("begun"), F.lit(0.0).cast("double").alias("score"))

    def step(state: Column, i: Column) -> Column:
        here = F.get(occurrences, i)
        last = F.transform(state["last"], lambda at, term: F.when(term == here["term"], i).otherwise(at))
        first = F.array_min(last)
        fresh = (first >= 0) & (first > state["begun"])
        others = (here["position"] - F.get(occurrences, F.greatest(first, F.lit(0)))["position"]) - (i - first)
        return F.struct(last.alias("last"), F.when(fresh, first).otherwise(state["begun"]).alias("begun"),
                        (state["score"] + F.when(fresh, F.lit(COVER) / (1 + others)).otherwise(F.lit(0.0))).alias("score"))

    places = F.sequence(F.lit(0), F.size(occurrences) - 1)
    return F.aggregate(places, start, step, lambda state: state["score"])


def ranked(found: DataFrame, terms: list[str]) -> DataFrame:
    """(key, score, hits) of the documents whose postings have all terms; score is the cover density, hits the share of words that are terms."""
    if not terms:
        return found.select("key", F.lit(0.0).alias("score"), F.lit(0.0).alias("hits")).limit(0)
    number = F.array_position(F.array(*map(F.lit, terms)), F.col("stem")).cast("int") - 1
    mine = found.filter(F.col("stem").isin(*terms)).select("key", "stem", "words", number.alias("term"), "positions")
    each = mine.groupBy("key").agg(F.count_distinct("stem").alias("n"), F.max("words").alias("words"), F.collect_list(F.struct("term", "positions")).alias("lists"))
    full = each.filter(F.col("n") == len(terms))
    pairs = F.flatten(F.transform("lists", lambda p: F.transform(p["positions"], lambda at: F.struct(at.alias("position"), p["term"].alias("term")))))
    rows = full.select("key", "words", F.array_sort(pairs).alias("occurrences"))
    return rows.select("key", cover_density(F.col("occurrences"), len(terms)).alias("score"), (F.size("occurrences") / F.col("words")).alias("hits"))


def ranked_texts(docs: DataFrame, key: str, text: str, query: str, stemmed: bool = True) -> DataFrame:
    """(key, score, hits) of documents with all terms of a query, without an index: texts are split once, and only the terms leave the task."""
    terms = terms_of(query, stemmed)
    return ranked(postings(docs, key, text, stemmed, terms), terms)


class Index:
    """An index in a folder. buckets and stemmed are the same for all its generations."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, stemmed: bool = True):
        self.spark, self.folder, self.buckets, self.stemmed = spark, folder.rstrip("/"), buckets, stemmed

    def generations(self) -> dict[int, str]:
        """Data folders of the generations by number, oldest first."""
        return {n: f"{self.folder}/{said['data']}" for n, said in commits.all_of(self.spark, self.folder).items()}

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, number: int, docs: DataFrame, key: str, text: str) -> int:
        place = commits.staged(self.folder)
        found = postings(docs, key, text, self.stemmed).withColumn("bucket", self._bucket(F.col("stem")))
        dealt = found.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(PARTS))).sortWithinPartitions("bucket", "stem", "key")
        dealt.write.partitionBy("bucket").parquet(f"{place}/postings")
        docs.filter(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct().write.parquet(f"{place}/keys")
        try:
            commits.commit(self.spark, self.folder, number, {"data": place.rsplit("/", 1)[1]})
        except commits.Conflict:
            commits.discard(self.spark, place)
            raise
        return number

    def build(self, docs: DataFrame, key: str, text: str) -> int:
        """A first generation of all documents, whose keys differ; raises Conflict where the folder holds one."""
        return self._write(0, docs, key, text)

    def refresh(self, changed: DataFrame, key: str, text: str) -> int:
        """A further generation of the documents that were added or have changed; a null text takes a document out."""
        return self._write((commits.taken(self.spark, self.folder) or [-1])[-1] + 1, changed, key, text)

    def buckets_of(self, terms: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self._bucket(F.col("term")).alias("bucket"))
        return sorted({r.bucket for r in rows.collect()})

    def postings_of(self, terms: list[str]) -> DataFrame:
        """The standing postings of some stems, from their buckets."""
        places = list(self.generations().values())
        if not places:
            raise ValueError(f"no index in {self.folder}")
        if not terms:
            return self.spark.read.parquet(f"{places[0]}/postings").select("key", "stem", "positions", "words").limit(0)
        at, parts = self.buckets_of(terms), []
        for i, place in enumerate(places):
            rows = self.spark.read.parquet(f"{place}/postings").filter(F.col("bucket").isin(*at) & F.col("stem").isin(*terms))
            rows = rows.select("key", "stem", "positions", "words")
            later = [self.spark.read.parquet(f"{p}/keys") for p in places[i + 1:]]
            parts.append(rows.join(reduce(DataFrame.unionByName, later), "key", "left_anti") if later else rows)
        return reduce(DataFrame.unionByName, parts)

    def search(self, query: str) -> DataFrame:
        """(key, score, hits) of the documents with all terms of a query."""
        terms = terms_of(query, self.stemmed)
        return ranked(self.postings_of(terms), terms)
