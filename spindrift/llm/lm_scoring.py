"""Language-model scores by stupid backoff, computed relationally.

Words and pairs of neighbouring words are counted over all documents: every
word and every pair, those met once too, in tables dealt by their hashes. As
the corpus scores itself, and a text would vouch for each of its own pairs,
every text is scored by the counts of all other texts, which are those of the
corpus less its own. A pair's score is its count over its first word's; a pair
that no other text has backs off to 0.4 times its second word's share of all
words of the corpus, where a word that no other text has counts as half a
word. A document's
score is the mean of its words' logarithmic scores.

A word is known by a 64-bit hash and a pair by those of its words; a gram is a
word or a pair, known by a 64-bit key (among 10^12 one equals some other with
a chance of 10^-7). Keys are dealt to buckets by their first bits, as many as
the texts' bytes ask for, so that a bucket is of bounded size. Grams are
combined within batches of texts and leave a worker as a row of lists for each
bucket; a row for each gram would cost far more to write and read than to
make. A bucket sums its lists and drops grams met once, which are no other
text's. The rest get their words' counts by two joins and become one row of
lists a bucket. Then the texts' own grams are made anew, a part of the
documents after another, and meet the counts by bucket; writing them in between
would take more disk than the input. What a bucket adds to the documents goes
back in lists too, by buckets of documents. A gram that counts more than 2^-16
of all words is scored where it is found, by a broadcast table that cannot
outgrow some 2^17 rows, so that no single gram fills a bucket. All tables are in
the shared folder; the driver learns the texts' bytes, the number of words and
the broadcast table.

Defined results: rows that share a doc_id (null is one too) are texts of their
own and vouch for one another, and their words make one mean; null and empty
texts have no words, and a document without words a null score; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, documents, materialize
from spindrift.llm.shingling import binary_texts, mixed, word_hashes

BACKOFF = 0.4
#: What a word counts that no other text has.
UNSEEN = 0.5
#: Parts of the documents whose own grams are shuffled one after another.
PARTS = 3
#: Rows whose words and pairs are combined before they leave a worker.
ROWS = 2048
#: The same for a text's own grams, which no batch combines.
OWN_ROWS = 512
#: Bytes of text for each bucket, some 700,000 words.
BUCKET_BYTES = 4 << 20
#: A gram that counts more than all words over this, and more than LEAST_HOT, is scored where it is found.
HOT, LEAST_HOT = 1 << 16, 1000
#: Stands for a text's start among the words' hashes.
START = 0x5BD1E9955BD1E995
#: As a gram's first word: the gram is a single word, and after it: one for each word at all.
SINGLE, EVERY = 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85
#: The lists of a bucket's counts.
MODEL = ["keys", "counts", "all_first", "all_second"]
#: The lists of a batch's own grams by bucket, and of what its documents have whatever the buckets hold.
OWN = "bucket int, ids array<long>, keys array<long>, ns array<int>, owns array<int>, firsts array<int>, docs array<long>, words array<long>, sums array<double>"
_OWN_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("ids", "keys")), *((c, pa.list_(pa.int32())) for c in ("ns", "owns", "firsts")),
                        *((c, pa.list_(pa.int64())) for c in ("docs", "words")), ("sums", pa.list_(pa.float64()))])


def _positions(column: pa.Array):
    """For each word of a batch: its row, its hash and that of the word before it; and whether it is a text's first."""
    texts = [word_hashes(t) for t in binary_texts(column)]
    sizes = np.array([len(t) for t in texts], np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    word = np.concatenate(texts) if texts else np.empty(0, np.uint64)
    first = np.r_[True, row[1:] != row[:-1]][:len(row)]
    before = np.where(first, np.uint64(START), np.r_[word[:1], word[:-1]])
    return row, word, before, first


def _keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The grams' keys: first, rotated by one bit, exclusive or second; gram_key() is the same on columns."""
    return ((first << np.uint64(1)) | (first >> np.uint64(63))) ^ second


def gram_key(first: Column, second: Column) -> Column:
    return F.shiftleft(first, 1).bitwiseOR(F.shiftrightunsigned(first, 63)).bitwiseXOR(second)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _slices(batches, size: int = ROWS):
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _new(*sorted_by: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    return np.flatnonzero(np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]][:len(x)] for x in sorted_by]))


def _runs(x: np.ndarray):
    """The order that sorts x, where its distinct values begin in it, and how often each is there."""
    order = np.argsort(x)
    starts = _new(x[order])
    return order, starts, np.diff(np.r_[starts, len(x)])


def _buckets(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, len(values)].astype(np.int32)), values)


def _flat(table: pa.Table, name: str) -> pa.Array:
    """A list column's values, one after another. An empty table's chunks may lack their offsets."""
    chunks = [c.flatten() for c in table.column(name).chunks if len(c)]
    return pa.concat_arrays(chunks) if chunks else pa.array([], table.schema.field(name).type.value_type)


def _numbers(table: pa.Table, name: str, kind=None) -> np.ndarray:
    found = _flat(table, name).to_numpy(zero_copy_only=False)
    return found.view(kind) if kind else found


def _dealt(first: np.ndarray, second: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of lists by bucket; within one, equal first words lie together, as they are compressed better so."""
    bucket = _buckets(_keys(first, second), bits)
    order = np.argsort((bucket.astype(np.uint64) << np.uint64(64 - bits)) | (first >> np.uint64(bits)))
    at = _new(bucket[order])
    return _batch(bucket=pa.array(bucket[order][at]), first=_lists(at, _longs(first[order])), second=_lists(at, _longs(second[order])),
                  ns=_lists(at, pa.array(n[order].astype(np.int32))))


def _grams(batches, bits: int):
    """For each bucket of a batch: first, second and n of its distinct words and of its pairs; and how many words and texts with words there are."""
    for batch in _slices(batches):
        _, word, before, start = _positions(batch.column(0))
        order, starts, n = _runs(word)
        single = np.r_[word[order[starts]], np.array([START, EVERY], np.uint64)]
        yield _dealt(np.full(len(single), SINGLE, np.uint64), single, np.r_[n, start.sum(), len(word)], bits)
        order, starts, n = _runs(_keys(before, word))
        where = order[starts]
        yield _dealt(before[where], word[where], n, bits)


def _summed(table: pa.Table) -> pa.Table:
    """first, second and count of a bucket's grams that are met more than once."""
    first, second, n = _numbers(table, "first", np.uint64), _numbers(table, "second", np.uint64), _numbers(table, "ns")
    order, starts, _ = _runs(_keys(first, second))
    count = np.add.reduceat(n[order].astype(np.int64), starts) if len(n) else np.empty(0, np.int64)
    where, count = order[starts[count > 1]], count[count > 1]
    return pa.table({"first": _longs(first[where]), "second": _longs(second[where]), "count": pa.array(count)})


def counts(docs: DataFrame, bits: int) -> DataFrame:
    """first, second and count of every word (SINGLE is first) and pair that is met more than once. A text's first word follows START."""
    found = docs.select("text").mapInArrow(functools.partial(_grams, bits=bits), "bucket int, first array<long>, second array<long>, ns array<int>")
    return found.groupBy("bucket").applyInArrow(_summed, "first long, second long, count long")


def _listed(table: pa.Table) -> pa.Table:
    """One row of lists with a bucket's counts by ascending key."""
    order = np.argsort(table.column("keys").to_numpy().view(np.uint64))
    whole = np.zeros(1, np.int64)
    return pa.table({c: table.column(c).slice(0, 1) if c == "bucket" else _lists(whole, pa.array(table.column(c).to_numpy()[order])) for c in table.column_names})


def _hottest(batches, least: int):
    """keys, counts, all_first and all_second of the grams that count more than least."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        columns = [_numbers(table, c) for c in MODEL]
        yield pa.RecordBatch.from_arrays([pa.array(x[columns[1] > least]) for x in columns], MODEL)


class _Scores:
    """What a text's own gram adds to its sum, beyond the score of words that no other text has."""

    def __init__(self, total: int, backoff: float, unseen: float):
        self.unseen, self.share = unseen, float(np.log(backoff) - np.log(max(total, 1)))
        self.least = float(np.log(unseen)) + self.share

    def backed(self, others: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(others, self.unseen)) + self.share

    def more(self, model, at, n, own, own_first) -> np.ndarray:
        """model: counts, all_first (0: the gram is a word) and all_second; at: the grams' rows there. A pair that others have does not back off."""
        count, all_first, all_second = (x[at] for x in model)
        backed, pair = self.backed(all_second - own), all_first > 0
        met = np.log(np.maximum(count - n, 1)) - np.log(np.maximum(all_first - own_first, 1)) - backed
        return n * np.where(pair, np.where(count > n, met, 0.0), backed - self.least)


def _found(keys: np.ndarray, wanted: np.ndarray):
    """Where each wanted key would stand among the sorted keys, and whether it is there."""
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _own_grams(batches, bits: int, hot: tuple, scores: _Scores):
    """Rows of OWN: each text's distinct words and pairs by bucket, with how often it has them and the words of the pairs. Hot ones are scored here."""
    for batch in _slices(batches, OWN_ROWS):
        row, word, before, start = _positions(batch.column(1))
        of_row = mixed(row + 1)
        order, starts, n = _runs(mixed(word) ^ of_row)
        own, w = np.empty(len(word), np.int64), order[starts]
        own[order] = np.repeat(n, n)
        own_first = np.where(start, 1, np.r_[own[:1], own[:-1]])
        keys = _keys(before, word)
        order, starts, m = _runs(keys ^ of_row)
        p = order[starts]
        keys = np.r_[_keys(np.full(len(w), SINGLE, np.uint64), word[w]), keys[p]]
        order = np.argsort(keys)
        keys, of, n = keys[order], np.r_[row[w], row[p]][order], np.r_[n, m][order]
        own, own_first = np.r_[own[w], own[p]][order], np.r_[np.zeros(len(w), np.int64), own_first[p]][order]
        at, here = _found(hot[0], keys)
        more = scores.more(hot[1:], at[here], n[here], own[here], own_first[here])
        words = np.bincount(row, minlength=batch.num_rows)
        sums = words * scores.least + np.bincount(of[here], more, minlength=batch.num_rows)
        rest = ~here
        keys, of, n, own, own_first = (x[rest] for x in (keys, of, n, own, own_first))
        bucket, kinds = _buckets(keys, bits), [f.type for f in _OWN_ARROW]
        at = _new(bucket)
        lists = [batch.column(0).take(pa.array(of)), _longs(keys), *(pa.array(x.astype(np.int32)) for x in (n, own, own_first))]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), *(_lists(at, x) for x in lists), *(pa.nulls(len(at), k) for k in kinds[6:])], schema=_OWN_ARROW)
        whole = np.zeros(1, np.int64)
        lists = [batch.column(0), pa.array(words.astype(np.int64)), pa.array(sums)]
        yield pa.RecordBatch.from_arrays([pa.array([len(word) % (1 << bits)], pa.int32()), *(pa.nulls(1, k) for k in kinds[1:6]), *(_lists(whole, x) for x in lists)], schema=_OWN_ARROW)


def _met(own: pa.Table, model: pa.Table, scores: _Scores, doc_bits: int) -> pa.Table:
    """ids, words and sums of what a bucket holds of the documents, in lists by the documents' own buckets."""
    keys, *columns = (_numbers(model, c) for c in MODEL)
    at, here = _found(keys.view(np.uint64), _numbers(own, "keys", np.uint64))
    n, owns, firsts = (_numbers(own, c)[here].astype(np.int64) for c in ("ns", "owns", "firsts"))
    more = scores.more(columns, at[here], n, owns, firsts)
    some = more != 0
    ids, docs = _flat(own, "ids").filter(pa.array(here)).filter(pa.array(some)), _flat(own, "docs")
    found = _added(pa.concat_arrays([ids, docs]), np.r_[np.zeros(len(ids), np.int64), _numbers(own, "words")], np.r_[more[some], _numbers(own, "sums")])
    bucket = _buckets(mixed(found.column("doc_id").fill_null(0).to_numpy()), doc_bits)
    order = np.argsort(bucket, kind="stable")
    at = _new(bucket[order])
    return pa.table({"bucket": pa.array(bucket[order][at]), **{k: _lists(at, found.column(c).combine_chunks().take(pa.array(order)))
                                                              for k, c in (("docs", "doc_id"), ("words", "n_words"), ("sums", "sum"))}})


def _added(ids: pa.Array, words: np.ndarray, sums: np.ndarray) -> pa.Table:
    """doc_id, n_words and sum of each document, a null one too."""
    found = pa.table({"doc_id": ids, "n_words": words, "sum": sums}).group_by("doc_id", use_threads=False).aggregate([("n_words", "sum"), ("sum", "sum")])
    return found.select(["doc_id", "n_words_sum", "sum_sum"]).rename_columns(["doc_id", "n_words", "sum"])


def _whole(table: pa.Table) -> pa.Table:
    return _added(_flat(table, "docs"), _numbers(table, "words"), _numbers(table, "sums"))


def score(docs: DataFrame, backoff: float = BACKOFF, unseen: float = UNSEEN) -> DataFrame:
    """doc_id, n_words and score of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(4, (size // BUCKET_BYTES).bit_length())
    often = materialize(counts(docs, bits), "lm-counts")
    single = F.lit(SINGLE).cast("long")
    words = often.filter(F.col("first") == single)
    total = words.filter(F.col("second") == F.lit(EVERY).cast("long")).agg(F.coalesce(F.sum("count"), F.lit(1))).first()[0]
    pairs = (often.filter(F.col("first") != single).join(words.select("second", F.col("count").alias("all_second")).hint("shuffle_hash"), "second")
             .join(words.select(F.col("second").alias("first"), F.col("count").alias("all_first")).hint("shuffle_hash"), "first"))
    both = words.withColumns({"all_first": F.lit(0).cast("long"), "all_second": F.col("count")})
    both = both.unionByName(pairs).select(gram_key(F.col("first"), F.col("second")).alias("keys"), F.col("count").alias("counts"), "all_first", "all_second")
    both = both.withColumn("bucket", F.shiftrightunsigned("keys", 64 - bits).cast("int"))
    model = materialize(both.groupBy("bucket").applyInArrow(_listed, ", ".join(f"{c} array<long>" for c in MODEL) + ", bucket int"), "lm-model")
    discard(often)
    hot = model.mapInArrow(functools.partial(_hottest, least=max(total // HOT, LEAST_HOT)), ", ".join(f"{c} long" for c in MODEL)).toArrow()
    order = np.argsort(hot.column("keys").to_numpy().view(np.uint64))
    keys, *columns = (hot.column(c).to_numpy()[order] for c in MODEL)
    scores = _Scores(total, backoff, unseen)
    doc_bits, sums = max(6, bits - 6), []
    for k in range(PARTS):
        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)) == k)
        own = part.mapInArrow(functools.partial(_own_grams, bits=bits, hot=(keys.view(np.uint64), *columns), scores=scores), OWN)
        met = own.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(lambda x, y: _met(x, y, scores, doc_bits), "bucket int, docs array<long>, words array<long>, sums array<double>")
        sums.append(materialize(met.groupBy("bucket").applyInArrow(_whole, "doc_id long, n_words long, sum double"), "lm-sums"))
    discard(model)
    return functools.reduce(DataFrame.union, sums).select("doc_id", "n_words", F.round(F.col("sum") / F.nullif("n_words", F.lit(0)), 6).alias("score"))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
