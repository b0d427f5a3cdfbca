"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight, but never more than
``max_epochs`` times what it has; what a capped source cannot take is shared
again, by weight, among the others. A source's target is then met by whole
repetitions of all its documents and one seeded fractional repetition.

Only per-source totals and, round by round, the totals of 1,024 hash buckets
of each source are gathered. The fractional repetition is a threshold on a
seeded hash of doc_id and text, so the decision for a document is an
expression over its own row and its source's plan. Plans of up to two million
sources are broadcast, and then no text is shuffled; past that texts are dealt
by source and salt.

Defined results: a null text has size 0; a null source is a source of its own
and comes last in code-point order; rows that repeat doc_id and text share one
decision; a source without words has target 0; an empty table gives an empty
result; all other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import BROADCAST_ROWS, documents, materialize, small, text_of, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 20240501
#: 2 to this power hash buckets for each source and round.
BUCKET_BITS = 10
#: Rows of a bucket that are ordered one by one.
LAST = 4096
#: Tasks that a source is dealt to where the plan is too large to broadcast.
SALTS = 256


def draw(seed: int = SEED) -> Column:
    """A seeded hash of 63 bits of a row's doc_id and text; smaller values are taken first."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 1)


def water_fill(sources: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to a table of (source, source_size, weight).

    Sources in order of the level at which they fill up: the level is the
    first at which the rest of the budget, over the weights not yet full, is
    below the next source's own. It equals resharing until none is above.
    The table has one row for each source, so one task may order it.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    by_fill = Window.orderBy("_fill", "weight", F.col("source").asc_nulls_last())
    rest = (F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
            - F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    left = F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levels = (sources.withColumn("_cap", cap).withColumn("_fill", F.col("_cap") / F.col("weight"))
              .withColumn("_level", rest / left).withColumn("_n", F.row_number().over(by_fill)))
    found = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_n", "_level"))).over(Window.partitionBy())
    level = found["_level"]
    return (levels.withColumn("target", F.when(level.isNull(), F.col("_cap"))
                              .otherwise(F.least("_cap", level * F.col("weight"))))
            .drop("_cap", "_fill", "_level", "_n"))


def cuts(sizes: DataFrame, filled: DataFrame) -> DataFrame:
    """source and cut: the documents with a draw up to it come nearest to the source's rest.

    The cut is narrowed by BUCKET_BITS bits of the draw a round: of each
    source's buckets the one in which its rest is reached stays, and only its
    rows are summed in the next round. Each round's table has one row for each
    source; rounds end when no bucket holds more than LAST rows.
    """
    state = filled.filter("rest > 0 and rest < source_size").select("source", F.lit(0).cast("long").alias("bucket"), "rest")
    bits = 0
    while True:
        state = small(materialize(state, "mix-cuts"))
        s, c = sizes.alias("s"), state.alias("c")
        inside = F.col("s.source").eqNullSafe(F.col("c.source")) & (F.shiftrightunsigned(F.col("s.draw"), 63 - bits) == F.col("c.bucket"))
        rows = s.join(c, inside).select("s.source", "s.draw", "s.size", "c.rest")
        step = min(bits + BUCKET_BITS, 63)
        sums = rows.groupBy("source", F.shiftrightunsigned("draw", 63 - step).alias("bucket"), "rest").agg(
            F.sum("size").alias("words"), F.count("*").alias("rows"))
        so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        reached = (sums.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
                   .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))))
        state = materialize(reached.select("source", "bucket", (F.col("rest") - F.col("before")).alias("rest"), "rows"), "mix-cuts")
        bits = step
        if bits == 63 or state.filter(F.col("rows") > LAST).isEmpty():
            break
        state = state.drop("rows")
    # at most LAST rows of a source, or rows of equal draws, which are summed first
    s, c = sizes.alias("s"), small(state).alias("c")
    inside = F.col("s.source").eqNullSafe(F.col("c.source")) & (F.shiftrightunsigned(F.col("s.draw"), 63 - bits) == F.col("c.bucket"))
    atoms = s.join(c, inside).groupBy("s.source", "draw", "bucket", "rest").agg(F.sum("size").alias("words"))
    within = Window.partitionBy("source").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("before") + F.col("words") / 2 <= F.col("rest")
    return (atoms.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0)))
            .groupBy("source", "bucket").agg(F.max(F.when(taken, F.col("draw"))).alias("draw"))
            .select("source", F.coalesce("draw", F.shiftleft(F.col("bucket"), 63 - bits) - 1).alias("cut")))


def plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source: source, source_size, target, whole, cut.

    sizes has source, size and draw. A document is taken ``whole`` times, and
    once more if its draw is at most ``cut``. The last document goes in if
    that brings the source nearer to its target.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    filled = (water_fill(totals.withColumn("weight", weight.cast("double")), share, max_epochs)
              .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                          .otherwise(F.lit(0)).cast("long"))
              .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    filled = materialize(filled, "mix-sources")
    p, q = filled.alias("p"), cuts(sizes, filled).alias("q")
    nothing = F.when(F.col("p.rest") >= F.col("source_size"), F.lit(2**63 - 1)).otherwise(F.lit(-1))
    return materialize(p.join(q, F.col("p.source").eqNullSafe(F.col("q.source")), "left")
                       .select("p.source", "source_size", "target", "whole", F.coalesce("q.cut", nothing).alias("cut")), "mix-plan")


def with_copies(rows: DataFrame, mix: DataFrame, drawn: Column, most: int = BROADCAST_ROWS) -> DataFrame:
    """_row (rows' columns), source_size, target and copies by the plan of the row's source.

    The plan, a row for each source, is broadcast up to ``most`` rows. Past
    that it is repeated for each of SALTS salts and joined by source and salt,
    so that a source with a third of all rows is dealt to that many tasks.
    """
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_row"), F.col("source").alias("_of"), drawn.alias("_draw"))
    side, on = mix.withColumnRenamed("source", "_source"), F.col("_of").eqNullSafe(F.col("_source"))
    if mix.count() <= most:
        side = F.broadcast(side)
    else:
        side = side.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = on & (F.pmod("_draw", F.lit(SALTS)) == F.col("_salt"))
    copies = F.col("whole") + (F.col("_draw") <= F.col("cut")).cast("long")
    return rows.join(side, on).select("_row", "source_size", "target", copies.alias("copies"))


def sizes_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (in words) and draw of every document."""
    return docs.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), draw(seed).alias("draw"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with docs' columns."""
    sizes = materialize(sizes_of(docs, seed), "mix-sizes")
    taken = with_copies(docs, plan(sizes, weights, share, max_epochs), draw(seed)).filter("copies > 0")
    taken = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    sizes = materialize(sizes_of(documents(spark, sf_dir)), "mix-sizes")
    return with_copies(sizes, plan(sizes), F.col("draw")).select(
        F.col("_row.doc_id").alias("doc_id"), F.col("_row.size").alias("size"), "source_size",
        F.col("target").cast("double").alias("target"), (F.col("_row.size") * F.col("copies")).alias("taken"))
