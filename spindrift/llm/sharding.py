"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts stay together: the groups of equal texts, in the order of a hash
of their text, are the atoms of the partition. The smallest capacity is found
by binary search: a capacity is feasible if filling shards greedily, group
after group, needs no more shards than there are. The cuts are where that
filling cuts.

The search runs over a bounded table at any input size. Groups first fall, by
the first bits of their hash, into 8,192 ordered cells. The smallest capacity
over whole cells bounds that over groups from above; the largest group and the
mean shard bound it from below. A greedy filling under the lower bound that
splits no cell, and one under the upper bound that splits them freely, enclose
every cut of every capacity in between. Cells of several groups that such a
cut may lie in are split by further bits, round after round, until only single
groups are left there: then the search's result is that over all groups.

Slots are offsets of parts of a shard plus ranks within them; a part is a hash
of doc_id and text, so a group of copies is ranked by many tasks.

Defined results: a null text counts as the empty text; equal rows get slots in
any order; rows with a null doc_id are dealt to parts by their place in the
table; an empty table gives an empty result; with fewer groups than shards,
the last shards are empty; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import discard, documents, materialize, small, text_of

SHARDS = 24
#: 2 to this power cells in the first round, and parts of a cell in each further one.
CELL_BITS = 13
SPLIT_BITS = 6
#: Cells of several groups above this share of a shard are always split.
LARGE = 64
#: Rows that one task ranks, about.
ROWS_A_TASK = 100_000
#: Bytes that a row takes besides its text.
ROW_BYTES = 8

_FITS = """aggregate(atoms, named_struct('n', 1L, 'used', 0L),
    (a, x) -> if(a.used + x.bytes <= {capacity},
                 named_struct('n', a.n, 'used', a.used + x.bytes),
                 named_struct('n', a.n + 1L, 'used', x.bytes)),
    a -> a.n <= {shards}L)"""

_CAPACITY = """aggregate(sequence(1, 63),
    named_struct('low', greatest(largest, (total + {shards}L - 1L) div {shards}L), 'high', total),
    (s, i) -> if(s.low >= s.high, s,
                 if({fits}, named_struct('low', s.low, 'high', (s.low + s.high) div 2L),
                            named_struct('low', (s.low + s.high) div 2L + 1L, 'high', s.high))),
    s -> s.low)"""

_STARTS = """aggregate(atoms, named_struct('used', 0L, 'starts', array(atoms[0].cell)),
    (a, x) -> if(a.used + x.bytes <= capacity,
                 named_struct('used', a.used + x.bytes, 'starts', a.starts),
                 named_struct('used', x.bytes, 'starts', array_append(a.starts, x.cell))),
    a -> a.starts)"""

# byte positions of the cuts; where is the one made before an atom that does not fit
_CUTS = """aggregate(atoms, named_struct('at', 0L, 'cut', 0L, 'cuts', array_repeat(0L, 0)),
    (a, x) -> if(a.at + x.bytes - a.cut <= {capacity},
                 named_struct('at', a.at + x.bytes, 'cut', a.cut, 'cuts', a.cuts),
                 named_struct('at', a.at + x.bytes, 'cut', {where}, 'cuts', array_append(a.cuts, {where}))),
    a -> a.cuts)"""


def cuts(atoms: DataFrame, shards: int = SHARDS) -> DataFrame:
    """From (cell, bytes and, where known, groups), one row: the smallest feasible capacity, each
    shard's first cell, and, for each cut, the bytes between which it may lie for groups."""
    if "groups" not in atoms.columns:
        atoms = atoms.withColumn("groups", F.lit(1))
    if "largest_group" not in atoms.columns:
        atoms = atoms.withColumn("largest_group", F.col("bytes"))
    fits = _FITS.format(capacity="((s.low + s.high) div 2L)", shards=shards)
    capacity = _CAPACITY.format(fits=fits, shards=shards)
    least = f"greatest(largest_group, (total + {shards}L - 1L) div {shards}L)"
    lows = _CUTS.format(capacity=least, where="a.at")
    highs = _CUTS.format(capacity="capacity", where="if(x.groups = 1, a.at, a.cut + capacity)")
    # what a lambda's variable holds is computed once, a column's expression may be moved into the loop
    found = f"""transform(array(cells), atoms -> transform(array({capacity}), capacity -> named_struct(
        'capacity', capacity, 'starts', {_STARTS}, 'total', total, 'lows', {lows}, 'highs', {highs}))[0])[0]"""
    return (atoms.agg(F.array_sort(F.collect_list(F.struct("cell", "bytes", "groups"))).alias("cells"), F.sum("bytes").alias("total"),
                      F.max("bytes").alias("largest"), F.max("largest_group").alias("largest_group"))
            .filter("total is not null").select(F.expr(found).alias("found")).select("found.*"))


def cells_of(groups: DataFrame, bits: int) -> DataFrame:
    """The atoms of groups (hash, bytes): cell, the least hash of a cell, bytes, groups and largest_group."""
    cell = F.shiftleft(F.shiftright("hash", 64 - bits), 64 - bits)
    return groups.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest_group"))


def minimax(groups: DataFrame, shards: int = SHARDS, bits: int = CELL_BITS, split_bits: int = SPLIT_BITS) -> tuple[int, list[int]]:
    """The smallest feasible capacity over groups (hash, bytes) in the order of hash, and each shard's first hash."""
    atoms = materialize(cells_of(groups, bits), "shard-cells")
    while True:
        layout = materialize(cuts(atoms, shards), "shard-layout")
        # at most some 100,000 atoms are ordered by one task, at any size of the input
        end = F.sum("bytes").over(Window.orderBy("cell"))
        inside = F.exists(F.sequence(F.lit(0), F.lit(max(0, shards - 2))), lambda k: (
            (F.col("end") > F.coalesce(F.get("lows", k), F.col("total")))
            & (F.col("end") - F.col("bytes") < F.coalesce(F.get("highs", k), F.col("total")))))
        open_cells = materialize(atoms.withColumn("end", end).join(F.broadcast(layout), how="cross")  # layout has one row
                                 .filter((F.col("groups") > 1) & (inside | (F.col("bytes") * (LARGE * shards) > F.col("total"))))
                                 .select(F.col("cell").alias("open")), "shard-open")
        if open_cells.isEmpty():
            row = layout.first()
            return (row.capacity, row.starts) if row else (0, [])
        cell = F.shiftleft(F.shiftright("hash", 64 - bits), 64 - bits)
        bits = min(64, bits + split_bits)
        parts = cells_of(groups.join(F.broadcast(open_cells), cell == F.col("open"), "left_semi"), bits)
        kept = atoms.join(F.broadcast(open_cells), F.col("cell") == F.col("open"), "left_anti")
        before, atoms = atoms, materialize(kept.unionByName(parts), "shard-cells")
        discard(before, layout, open_cells)


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document."""
    text = text_of()
    rows = materialize(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("at")), "shard-rows")
    groups = materialize(rows.groupBy("hash").agg(F.sum("size").alias("bytes")), "shard-groups")
    starts = minimax(groups, shards)[1]
    discard(groups)
    home = F.size(F.filter(F.lit(starts).cast("array<long>"), lambda s: s <= F.col("hash"))) - 1
    parts = max(64, rows.count() // (ROWS_A_TASK * shards))
    part = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("at")).otherwise(F.xxhash64("doc_id", "hash")), F.lit(parts))
    placed = rows.select("doc_id", "size", "text_crc32", home.alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")), "shard-offsets")
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return (placed.withColumn("nth", rank).join(small(offsets), ["shard", "part"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("nth")).alias("slot")))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
