"""Keyed tables in buckets: a merge rewrites the buckets that it touches and commits a snapshot that names all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spindrift.operators import commits
from spindrift.operators.store import _without, last_of, upsert
from spindrift.session import settled

BUCKETS = 64
#: The column that names a row's bucket, in the files only.
BUCKET = "_bucket"


class BucketedTable:
    """A table by keys under a folder. Its number of buckets is set when it is first written and read from its snapshots after.

    A snapshot says for each bucket which data folder holds it. Files are never changed, so readers of a
    snapshot are not disturbed, and buckets that a merge does not touch keep their files. A merge begins from
    the last snapshot and commits the next number; if another writer has committed that meanwhile, it raises Conflict and leaves nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.schema, self.keys, self._buckets = spark, folder.rstrip("/"), schema, keys, buckets

    def snapshot(self) -> tuple[int, dict]:
        """Number and contents of the last snapshot; 0 and no buckets before the first."""
        return commits.latest(self.spark, self.folder) or (0, {"buckets": self._buckets, "held": {}})

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.keys)), F.lit(buckets)).cast("int")

    def read(self, said: dict | None = None, only: set[int] | None = None) -> DataFrame:
        """The rows of the last snapshot, or of one, or of some of its buckets."""
        said = self.snapshot()[1] if said is None else said
        paths = [f"{self.folder}/{place}/{BUCKET}={b}" for b, place in said["held"].items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, order: str | None = None, keep: tuple[str, ...] = ()) -> int:
        """Upsert a batch by key; of rows with one key the last by order counts. Returns the snapshot's number."""
        rows = last_of(batch, self.keys, order) if order else batch.dropDuplicates(self.keys)
        return self._commit(rows, lambda old, new: upsert(old, new, self.keys, keep))

    def replace(self, parents: DataFrame, names: list[str], rows: DataFrame) -> int:
        """Put rows in the place of all rows of some parents. The table must be kept by columns among those that name the parent,
        so that a parent's rows share a bucket."""
        if not set(self.keys) <= set(names):
            raise ValueError(f"buckets by {self.keys} do not follow {names}")
        whose = parents.select(*names).distinct()
        return self._commit(rows, lambda old, new: _without(old, whose, names).unionByName(new), also=whose)

    def _commit(self, rows: DataFrame, change, also: DataFrame | None = None) -> int:
        number, said = self.snapshot()
        buckets = said["buckets"]
        new = settled(rows.select(*self.schema.names), "batch")
        asked = new.select(self._bucket(buckets).alias("b"))
        asked = asked if also is None else asked.union(also.select(self._bucket(buckets).alias("b")))
        touched = {r.b for r in asked.distinct().collect()}  # at most as many as there are buckets
        if not touched:
            return number
        changed = change(self.read(said, touched), new).select(*self.schema.names)
        place = commits.staged(self.folder)
        changed.withColumn(BUCKET, self._bucket(buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(place)
        path, fs = commits._at(self.spark, place)
        written = {f.getPath().getName().partition("=")[2] for f in fs.listStatus(path) if "=" in f.getPath().getName()}
        held = {b: p for b, p in said["held"].items() if int(b) not in touched} | {b: place.rsplit("/", 1)[1] for b in written}
        try:
            commits.commit(self.spark, self.folder, number + 1, {"buckets": buckets, "held": held})
        except commits.Conflict:
            commits.discard(self.spark, place)
            raise
        return number + 1


def sync(spark: SparkSession, sources: dict, save) -> dict[str, Exception | None]:
    """Run sources in their order, each a function that gives batches; one that fails does not stop the rest. Returns what failed, by name."""
    out: dict[str, Exception | None] = {}
    for name, source in sources.items():
        out[name] = None
        try:
            for batch in source():
                save(name, batch)
        except Exception as e:  # noqa: BLE001 - told to the caller by source
            out[name] = e
    return out
