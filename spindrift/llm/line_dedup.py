"""Line dedup: lines that several documents share stay in one of them only.

Every line's key is hashed to 128 bits. The hashes are range-partitioned and
sorted by document (largest first) and position within them, and each
partition is streamed once: the first document of a hash keeps its lines, and
once enough documents have been seen the lines of all others go. A hash may
run over the end of a partition, because ranges also split by document, so a
line that a third of all documents share is streamed by many tasks. Such runs
leave a note with their number of documents; at most two notes a partition
are added up, and settle the rows that were left open.

The result is a compressed bitmap of kept lines for each document, no text.

Defined results: null and empty texts have one empty line; null doc_ids are
one document below all others; rows that repeat a doc_id count as one document, each with its
own bitmap by text; an empty table gives an empty result; columns other than
doc_id and text are kept by drop_lines, whatever their names, and otherwise ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import discard, documents, mapped, materialize, packed, text_of, unpacked

MIN_CHARS = 20
MIN_DOCS = 3
BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NO_ID = -(2**63)

DROPPED, NOTE, OPEN = 0, 1, 2
KEYS = "did long, th long, h1 long, h2 long, pos int"
EVENTS = pa.schema([("kind", pa.int8()), ("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()),
                    ("th", pa.int64()), ("pos", pa.int32()), ("n", pa.int64())])


def _line_keys(min_chars: int):
    def keys(batches):
        for batch in batches:
            did, th, pos, hashes = [], [], [], []
            for d, t, text in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2)):
                for i, line in enumerate(text.as_buffer().to_pybytes().translate(LOWER).split(b"\n")):
                    line = line.strip(BLANK)
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                        did.append(d)
                        th.append(t)
                        pos.append(i)
                        hashes.append(xxhash.xxh3_128_digest(line))
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])),
                 pa.array(np.ascontiguousarray(h[:, 1])), pa.array(pos, pa.int32())], ["did", "th", "h1", "h2", "pos"])
    return keys


def _stream(min_docs: int):
    """Over one sorted partition: rows that go, rows left open, notes on the runs at its ends."""

    def events(kind, rows, n=None):
        size = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, kind, np.int8)), *(pa.array(rows[:, i]) for i in (0, 1, 2, 3)),
             pa.array(rows[:, 4].astype(np.int32)), pa.array(np.full(size, n or 0, np.int64))], schema=EVENTS)

    def stream(batches):
        key, first_run, docs, holder, last, waiting = None, True, 0, None, None, []
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], 1)
            if not len(rows):
                continue
            new_key = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]
            new_doc = new_key | np.r_[True, rows[1:, 2] != rows[:-1, 2]]
            starts = np.flatnonzero(new_key)
            ends = np.r_[starts[1:], len(rows)]
            for k, (a, b) in enumerate(zip(starts, ends)):
                head = (rows[a, 0], rows[a, 1])
                if k == 0 and key is not None and head == key:
                    fresh = int(new_doc[a + 1:b].sum()) + int(rows[a, 2] != last)
                else:
                    if key is not None and first_run:
                        yield events(NOTE, np.array([[*key, holder, 0, 0]], np.int64), docs)
                    first_run = key is None
                    key, docs, holder, waiting, fresh = head, 0, rows[a, 2], [], int(new_doc[a:b].sum())
                last = rows[b - 1, 2]
                if first_run:
                    docs += fresh
                    yield events(OPEN, rows[a:b])
                    continue
                if b - a == 1 and docs == 0:  # most runs are one line
                    docs = 1
                    continue
                docs += fresh
                others = rows[a:b][rows[a:b, 2] != holder]
                if docs >= min_docs:
                    for part in (*waiting, others):
                        if len(part):
                            yield events(DROPPED, part)
                    waiting = []
                elif len(others):
                    waiting.append(others)
        if key is not None:
            yield events(NOTE, np.array([[*key, holder, 0, 0]], np.int64), docs)
            for part in waiting:
                yield events(OPEN, part)

    def merged(batches):
        held, size = [], 0
        for out in stream(batches):
            held.append(out)
            size += out.num_rows
            if size >= 50_000 or len(held) >= 5_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return merged


def _keys_of() -> list:
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("_did"), F.xxhash64(text_of()).alias("_th")]


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """did, th, n_dropped and keep for each document that loses a line.

    keep is a zlib-compressed bitmap, most significant bit first, with a 1 for
    each kept line up to the last dropped one; later lines are kept. A
    document with no row here keeps all its lines.
    """
    keyed = docs.select(*_keys_of(), text_of().cast("binary").alias("text")).mapInArrow(_line_keys(min_chars), KEYS)
    keyed = materialize(keyed, "line-keys")  # read twice, for the ranges too
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = (keyed.repartitionByRange(ranges, "h1", "h2", F.col("did").desc())
                .sortWithinPartitions("h1", "h2", F.col("did").desc(), "th", "pos")
                .select("h1", "h2", "did", "th", "pos")
                .mapInArrow(_stream(min_docs), "kind byte, h1 long, h2 long, did long, th long, pos int, n long"))
    streamed = materialize(streamed, "line-events")
    discard(keyed)
    settled = (streamed.filter(F.col("kind") == NOTE).groupBy("h1", "h2")
               .agg(F.sum("n").alias("docs"), F.max("did").alias("holder")).filter(F.col("docs") >= min_docs))
    # at most two notes for each partition of the sorted lines
    reopened = (streamed.filter(F.col("kind") == OPEN).join(F.broadcast(settled), ["h1", "h2"])
                .filter(F.col("did") != F.col("holder")))
    gone = streamed.filter(F.col("kind") == DROPPED).select("did", "th", "pos").union(reopened.select("did", "th", "pos"))

    def pack(batches):
        for batch in batches:
            out = []
            for spots in batch.column(2).to_pylist():
                keep = np.ones(max(spots) // 8 * 8 + 8, np.uint8)
                keep[spots] = 0
                out.append((int(len(keep) - keep.sum()), zlib.compress(np.packbits(keep).tobytes())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()),
                 pa.array([x[1] for x in out], pa.binary())], ["did", "th", "n_dropped", "keep"])

    spots = gone.groupBy("did", "th").agg(F.collect_set("pos").alias("spots"))
    return spots.mapInArrow(pack, "did long, th long, n_dropped long, keep binary")


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The kept lines of a document as booleans."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines]
    return np.r_[bits, np.ones(n_lines - len(bits), np.uint8)].astype(bool)


def _kept(batch):
    texts, counts = [], []
    for text, keep in zip(batch.column(0), batch.column(1).to_pylist()):
        lines = text.as_buffer().to_pybytes().split(b"\n")
        counts.append(len(lines))
        if keep is not None:
            lines = [x for x, k in zip(lines, unpack(keep, len(lines))) if k]
        texts.append(b"\n".join(lines))
    return [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), batch.column(2), batch.column(3)]


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, without text, with _kept (the text without dropped lines), _n_lines, _n_dropped and _null (no text)."""
    maps = keep_bitmaps(docs, min_docs, min_chars).hint("shuffle_hash")
    others, rest = packed(docs, ["text", "_kept", "_n_lines", "_n_dropped", "_null"])
    rows = docs.select(*_keys_of(), F.col("text"), *rest)
    joined = rows.join(maps, (F.col("_did") == F.col("did")) & (F.col("_th") == F.col("th")), "left")
    inputs = {"text": text_of().cast("binary"), "keep": F.col("keep"), "dropped": F.coalesce("n_dropped", F.lit(0)), "null": F.col("text").isNull()}
    out = mapped(joined, inputs, _kept, "_kept string, _n_lines long, _n_dropped long, _null boolean",
                 without=["_did", "_th", "did", "th", "text", "keep", "n_dropped"])
    return out.select("_kept", "_n_lines", "_n_dropped", "_null", *unpacked(others))


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                                   F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))
