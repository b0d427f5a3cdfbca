"""Spelling variants by permuterm rotations.

A word with a terminator has one rotation for each of its places. Turned so
that the edited place is last, a rotation without its last character is the
same for all words that differ there, and is the whole rotation of the word
that lacks the character. So each word gives, for each place, the rotation
that skips the character there and the whole rotation that begins there. All
rotations are range-partitioned and sorted; words that share one are a prefix
range, which is scanned as one group. A group holds at most one word for each
letter that may stand at the place, and the word without it, whatever the size
of the table.

A pair that differs by a replacement shares exactly one rotation. One that
differs by an indel inside a run of equal characters would share several; the
first character of a run stands for all. So near words are counted in the
scan, group by group, and no pairs are written: a group gives each member its
number of others and the best of them.

Words are known by ids that sort as the words do. Rotations of up to
``PLAIN`` code points are their own sort key. Longer ones sort by two rolling
hashes modulo 2^61 - 1, so a word of any length gives rows of fixed size; equal
hashes of different rotations have a chance below 2^-100.

Defined results: null and empty texts have no words; a null doc_id is read as
an empty one in the hash that deletes characters; rows that repeat count
again; ties go to the first word in code-point order; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import documents, materialize, text_of

#: Runs of these, after A-Z are lower-cased, are words.
RUN = "[a-zÀ-ÿ]+"
LOWER = {i: i + 32 for i in range(65, 91)}
#: One run in so many loses a character, chosen by a hash of the document's id and the run.
ONE_IN = 199
MIN_CHARS, MIN_COUNT = 6, 5
#: A word's form is at least so many times as frequent.
TIMES = 5
#: Distinct words that a task counts before it writes them out.
HELD = 200_000
END = "$"
PLAIN = 65
MODULUS = (1 << 61) - 1
BASES = (911_382_323, 972_663_749)

ROTATIONS = "key string, id long, n long, kind int"
#: Kinds of rows: the whole rotation; one that skips a character, first of its run or not.
WHOLE, FIRST, LATER = 0, 1, 2


def edited(doc_id, run: str) -> str:
    """A lower-cased run as the document spells it."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % ONE_IN else run[:h % len(run)] + run[h % len(run) + 1:]


def _counted(min_chars: int, edit):
    find = re.compile(RUN).findall

    def count(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for run, n in Counter(find(text.as_py().translate(LOWER))).items():
                    word = edit(doc_id, run) if edit else run
                    if len(word) >= min_chars:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
                    held = Counter()
        yield out()

    return count


def word_counts(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, edit=edited) -> DataFrame:
    """word and n, its occurrences in all documents; edit(doc_id, run) spells each run, None leaves them."""
    found = docs.select("doc_id", text_of().alias("text")).mapInArrow(_counted(min_chars, edit), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def numbered(words: DataFrame) -> DataFrame:
    """The words with ids that are in their order."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    return materialize(ordered.withColumn("id", F.monotonically_increasing_id()), "variant-words")


def rotation_keys(word: str) -> list[tuple[str, int]]:
    """Sort key and kind of each rotation: whole ones from every place, and those that skip each place."""
    n = len(word)
    kinds = [FIRST if i == 0 or word[i] != word[i - 1] else LATER for i in range(n)]
    if n + 1 <= PLAIN:
        whole = [(word[i:] + END + word[:i], WHOLE) for i in range(n + 1)]
        return whole + [(word[i + 1:] + END + word[:i], kinds[i]) for i in range(n)]
    heads, powers = [], []
    for base in BASES:
        head, power = [0], [1]
        for ch in word:
            head.append((head[-1] * base + ord(ch)) % MODULUS)
            power.append(power[-1] * base % MODULUS)
        heads.append(head)
        powers.append(power)

    def key(start: int, stop: int) -> str:
        """Of word[start:] + END + word[:stop], by the hashes of the word's beginnings."""
        if n - start + 1 + stop <= PLAIN:
            return word[start:] + END + word[:stop]
        both = []
        for base, head, power in zip(BASES, heads, powers):
            tail = (head[n] - head[start] * power[n - start]) % MODULUS
            both.append(((tail * base + ord(END)) * power[stop] + head[stop]) % MODULUS)
        return f"{END}{n - start + stop}:{both[0]:x}:{both[1]:x}"

    return [(key(i, i), WHOLE) for i in range(n + 1)] + [(key(i + 1, i), kinds[i]) for i in range(n)]


def _rotated(batches):
    for batch in batches:
        out: list = []
        for word, n, id_ in zip(*(c.to_pylist() for c in batch.columns)):
            for key, kind in rotation_keys(word):
                out.append((key, id_, n, kind))
            if len(out) >= 100_000:
                yield _rows(out)
                out = []
        yield _rows(out)


def _rows(out: list) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "id", "n", "kind"])


def _near(group: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """For each (id, n, kind) of one rotation: id, how many others are near, and the n and id of the best of them."""
    whole = [g for g in group if g[2] == WHOLE]
    skips = [g for g in group if g[2] != WHOLE]
    best = lambda found: min((-n, i) for i, n, _ in found)
    out = []
    if len(skips) > 1:  # replacements: the best of the others is the best of all or the second
        ranked = sorted(skips, key=lambda g: (-g[1], g[0]))[:2]
        for id_, _, _ in skips:
            other = ranked[1] if ranked[0][0] == id_ else ranked[0]
            out.append((id_, len(skips) - 1, other[1], other[0]))
    longer = [g for g in skips if g[2] == FIRST]
    if whole and longer:
        top = best(longer)
        out += [(id_, len(longer), -top[0], top[1]) for id_, _, _ in whole]
        out += [(id_, 1, whole[0][1], whole[0][0]) for id_, _, _ in longer]
    return out


def _scanned(batches):
    """Streams sorted rotations and looks at the words of one at a time."""
    key, group, out = None, [], []

    def rows():
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n_near", "best_n", "best"])

    for batch in batches:
        for k, id_, n, kind in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if len(group) > 1:
                    out += _near(group)
                key, group = k, []
            group.append((id_, n, kind))
        if len(out) >= 50_000:
            yield rows()
            out = []
    if len(group) > 1:
        out += _near(group)
    yield rows()


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best and best_n, the most frequent near word, of the words (word, n, id) that have near ones."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rotations = materialize(words.select("word", "n", "id").mapInArrow(_rotated, ROTATIONS), "variant-rotations")  # read twice, for the ranges too
    ordered = rotations.repartitionByRange(parts, "key").sortWithinPartitions("key").select("key", "id", "n", "kind")
    found = ordered.mapInArrow(_scanned, "id long, n_near long, best_n long, best long")
    top = F.max(F.struct("best_n", (-F.col("best")).alias("at")))  # ids sort as words do, so the smallest is the first word
    return found.groupBy("id").agg(F.sum("n_near").alias("n_near"), top.alias("_top")).select(
        "id", "n_near", F.col("_top.best_n").alias("best_n"), (-F.col("_top.at")).alias("best"))


def variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, times: int = TIMES, edit=edited) -> DataFrame:
    """word, n, n_near, form, form_n and root for each word of the documents."""
    counts = materialize(word_counts(docs, min_chars, min_count, edit), "variant-counts")  # read twice, for the ranges too
    words = numbered(counts)
    near = near_words(words)
    is_form = F.col("best_n") >= times * F.col("n")
    table = words.join(near, "id", "left").select("word", "n", "id", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                  F.when(is_form, F.col("best")).alias("form_id"), F.when(is_form, F.col("best_n")).alias("form_n"))
    table = materialize(table, "variant-forms")
    most = table.agg(F.max("n")).first()[0] or 1
    # each form is several times as frequent as its word, so chains are short; each round doubles the steps
    steps = math.ceil(math.log(max(most, 2), times)) + 1
    roots = table.filter("form_id is not null").select("id", F.col("form_id").alias("root_id"))
    for _ in range(math.ceil(math.log2(steps))):
        nexts = roots.select(F.col("id").alias("root_id"), F.col("root_id").alias("_next"))
        roots = materialize(roots.join(nexts, "root_id", "left").select("id", F.coalesce("_next", "root_id").alias("root_id")), "variant-roots")
    named = lambda at, name: words.select(F.col("id").alias(at), F.col("word").alias(name))
    return (table.join(roots, "id", "left").join(named("form_id", "form"), "form_id", "left").join(named("root_id", "_root"), "root_id", "left")
            .select("word", "n", "n_near", "form", "form_n", F.coalesce("_root", "word").alias("root")))


def op12_variants(spark, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")
