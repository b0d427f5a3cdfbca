"""Bottom-k sketches of word shingles.

A text's sketch holds the k smallest hashes of its five-word shingles (of the
whole word sequence where there are fewer words), in order. The sketch of a
union is the k smallest hashes of both sketches, so sketches of parts merge.
Over two sketches the share of common hashes among the k smallest of their
union estimates resemblance; a full sketch's largest hash tells how dense the
hashes lie and so the number of distinct shingles, and with that containment.

Everything is an expression on columns. Where a value is used repeatedly
inside higher-order functions it is bound once, so each text is split and
hashed once.

Defined results: null and empty texts, and texts of white space, have the
empty sketch; two empty sketches resemble each other fully, an empty and a
non-empty one not at all; equal texts have equal sketches; repeated doc_ids
are ordered by their text; null doc_ids come first; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import documents, let, materialize, small, text_of, words_of

K = 128
SHINGLE = 5


def shingle_hashes(words: Column, width: int = SHINGLE) -> Column:
    """Hashes of all shingles of an array of words, in order and with repeats."""
    return let(words, lambda w: F.when(F.size(w) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1))),
                    lambda i: F.xxhash64(F.slice(w, i, width)))))


def smallest(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    return smallest(shingle_hashes(words_of(text), width), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return smallest(F.concat(a, b), k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, from 0 to 1."""
    shared = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b))
    return F.coalesce(let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared(u) / F.size(u))),
                      F.lit(0.0))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    reach = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / reach)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def written(a: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def read(text: Column) -> Column:
    """The sketch that was written as text."""
    at = F.sequence(F.lit(0), (F.length(text) / 16 - 1).cast("int"))
    digits = lambda i, j: F.conv(F.substr(text, i * 16 + j, F.lit(8)), 16, 10).cast("long")
    return F.when(F.length(text) == 0, F.array().cast("array<long>")).otherwise(
        F.transform(at, lambda i: F.shiftleft(digits(i, 1), 32).bitwiseOR(digits(i, 9))))


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts lie below value, by a search in two steps."""
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.lit(cuts[step - 1::step]).cast("array<long>")
    below = lambda part: F.size(F.filter(part, lambda c: c < value))
    return let(below(coarse) * step, lambda at: at + below(F.slice(F.lit(cuts).cast("array<long>"), at + 1, step)))


def in_order(docs: DataFrame, rows_a_range: int = 1_000, most_cuts: int = 16_384) -> DataFrame:
    """doc_id, text, and what a window needs to see the next row by doc_id.

    Rows are dealt into ranges of doc_id, so that no task orders all of them;
    ranges between most_cuts cuts are dealt further by equal steps of doc_id
    where they would hold more rows. Each range ends with a copy of the first
    row of the range after it (after the last one: of the first), marked by
    ``_copy``; next_row() orders a range.
    """
    at = F.coalesce("doc_id", F.lit(-(2**63)))
    wanted = docs.count() // rows_a_range + 1
    ranges = min(most_cuts, wanted)
    shares = [i / ranges for i in range(1, ranges)]
    cuts = docs.select(F.percentile_approx(at, shares, 20 * ranges)).first()[0] if shares else []
    rows = docs.select("doc_id", at.alias("_at"), text_of().alias("text"), F.lit(0).alias("_copy"))
    coarse = range_of(F.col("_at"), sorted(set(cuts))) if cuts else F.lit(0)
    rows = rows.withColumn("_range", F.struct(coarse.cast("int").alias("cut"), F.floor(F.col("_at") / _step(cuts, wanted)).cast("long").alias("part")))
    # one row of a few numbers for each range; a window over them in order sees no text
    starts = materialize(rows.groupBy("_range").agg(F.min("_at").alias("_at")), "ranges")
    by_range = Window.orderBy("_range")
    lead = F.coalesce(F.lag("_range").over(by_range), F.max("_range").over(Window.partitionBy()))
    starts = small(materialize(starts.withColumn("_before", lead), "ranges"))
    firsts = rows.join(starts, ["_range", "_at"]).groupBy("_range", "_before").agg(F.min("text").alias("text"))
    copies = firsts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(2**63 - 1).alias("_at"), "text",
                           F.lit(1).alias("_copy"), F.col("_before").alias("_range"))
    return rows.unionByName(copies)


def _step(cuts: list[int], wanted: int) -> float:
    """Width in doc_id of a range's parts; one part where the cuts are as many as wanted."""
    if len(cuts) + 1 >= wanted:
        return 2.0**63
    return max(1.0, float(cuts[-1] - cuts[0]) / wanted)


def next_row():
    """The window in which the next row of in_order() is the next one."""
    return Window.partitionBy("_range").orderBy("_at", "_copy", "text")


def fingerprints(docs: DataFrame, k: int = K, width: int = SHINGLE) -> DataFrame:
    """The sketch of every text, of its edited text, and of the next one.

    The edited text ends with the next text's beginning in place of its own
    last quarter. Its shingles up to there are the text's own and are hashed
    once.
    """
    rows = in_order(docs).withColumn("_next", F.lead("text", 1, "").over(next_row()))
    n = F.length("text")
    kept = n - F.floor(n / 4)
    head = F.substr(F.col("text"), F.lit(1), kept.cast("int"))
    edited = F.concat(head, F.substr(F.col("_next"), F.lit(1), (n - kept).cast("int")))
    # words that surely end within the head
    whole = let(head, lambda h: F.size(words_of(h)) - h.rlike(r"[^\x20\x09-\x0D]\z").cast("int"))
    rows = rows.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"),
                       F.greatest(whole - (width - 1), F.lit(0)).alias("_same"))
    none = F.array().cast("array<long>")

    def tail(words, same):
        rest = F.slice(words, same + 1, F.greatest(F.size(words), F.lit(1)))
        return let(rest, lambda r: F.when((same > 0) & (F.size(r) < width), none).otherwise(shingle_hashes(r, width)))

    def both(s):
        return F.struct(smallest(s["own"], k).alias("own"),
                        smallest(F.concat(F.slice(s["own"], 1, s["same"]), tail(s["words"], s["same"])), k).alias("edited"))

    parts = F.struct(shingle_hashes(words_of(F.col("text")), width).alias("own"),
                     words_of(F.col("edited")).alias("words"), F.col("_same").alias("same"))
    rows = rows.withColumn("_sketch", let(parts, both)).withColumn("_next_sketch", F.lead("_sketch.own").over(next_row()))
    return (rows.filter("_copy = 0")
            .select("doc_id", "n_chars", "edited", F.col("_sketch.own").alias("sketch"),
                    F.col("_sketch.edited").alias("edited_sketch"), F.col("_next_sketch").alias("next_sketch")))


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
