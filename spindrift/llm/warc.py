"""WARC archives: a writer, and a reader that salvages what damage has left.

Each record is a gzip member of its own. Tasks write their rows one after the
other, so an archive holds whole members and Spark's own commit decides which
archives count. Of rows with equal payloads one is stored in full and the
others are revisit records that name it.

The reader takes archives of members, of plain records, or both. A member
must decode, with its checksum; a record must have a version line, a length,
an end, and the digests that it states. Where a check fails the reader looks
for the next member or version line that does pass, reports the bytes before it
as a gap, and goes on there, so that one torn place costs the records it
touches and no others. A plain record whose digest fails may have a wrong
length too, so the search begins right behind its version line.

Archives are read whole, one row each; the writer deals rows so that an archive
comes to about ``ARCHIVE_BYTES`` before compression, more only for a single larger record.

Defined results: a null html is an empty payload; a null url has no target line;
rows that share the largest page_id of equal payloads are responses all; a null
page_id is never the largest unless all are null, and those rows are responses; an empty table
gives no archive and an empty result; columns other than page_id, url and html
are ignored. A revisit whose response is lost has null payload_bytes and the
digest that it states.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spindrift.llm.common import materialize, remove, small, table_path

VERSION = b"WARC/1.1"
#: Payloads below this are stored in full each time.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
# The WARC standard's name for revisits known by their payload's digest, and gzip's magic number with its only method.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MAGIC = b"\x1f\x8b\x08"
SAFE = "%/:?#[]@!$&'()*+,;=~"
ID = "urn:page:"
#: Parts of a member that are decoded at a time.
WINDOW = 1 << 16
#: Payload bytes after which a task hands on what it has read.
HANDED = 8 << 20
SPLIT = 16

FOUND = ("archive string, start long, stop long, gap string, record_type string, record_id string, refers_to string, target_uri string, "
         "stated_digest string, payload binary")


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page_id, url: str | None, payload: bytes, digest: str, refers_to=None, date: str = DATE) -> bytes:
    """One record's bytes; a revisit has headers only and names what it repeats."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'null' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe=SAFE))
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}", f"WARC-Block-Digest: {sha1_label(block)}",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero: from 16 MB on an empty member follows, whose length is."""
    pack = lambda d: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(d) + c.flush()
    out = pack(data)
    return out if out[-1] == 0 else out + pack(b"")


def with_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, record_type and refers_to.

    Payloads are known by length and SHA-1. Only those that two rows share are looked up, by
    their digests; a payload that many rows share is dealt over parts, for where the table of them is not small.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    known = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    shared = (known.filter(F.col("size") >= least).groupBy("sha", "size").agg(F.count("*").alias("copies"), F.max("page_id").alias("holder"))
              .filter("copies > 1 and holder is not null").drop("copies"))
    shared = materialize(shared, "warc-shared").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    part = F.pmod(F.xxhash64("page_id", "url"), F.lit(SPLIT)).cast("int")
    joined = known.withColumn("part", part).join(small(shared), ["sha", "size", "part"], "left")
    again = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("holder")).alias("refers_to"))


def _members(date: str):
    def run(batches):
        for batch in batches:
            out, size = [], 0
            for page_id, url, payload, kind, refers_to in zip(*(c for c in batch.columns)):
                data = payload.as_py()
                packed = member(record(kind.as_py(), page_id.as_py(), url.as_py(), data, sha1_label(data), refers_to.as_py(), date))
                out.append(packed[:-1])
                size += len(packed)
                if size > HANDED:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    return run


def write_archives(pages: DataFrame, path: str, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE) -> None:
    """Archives of all pages as files in a folder.

    Spark's text files take rows of any bytes and end each with the separator. Members end in a
    zero byte, which is the separator here, so files hold nothing but members.
    """
    total = pages.agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long") + 600)).first()[0] or 0
    dealt = with_types(pages, least).repartition(max(1, -(-total // archive_bytes)))
    members = dealt.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(_members(date), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


class Damage(Exception):
    """Bytes that are no record."""


def read_member(view: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The data of the gzip member that begins there, where it ends, and what is wrong with it."""
    inflate, out, here, wrong = zlib.decompressobj(31), [], at, None
    try:
        while not inflate.eof:
            window = view[here:here + WINDOW]
            if not window:
                wrong = "torn member"
                break
            out.append(inflate.decompress(window))
            here += len(window)
    except zlib.error as e:
        wrong = f"bad member: {e}"
    return b"".join(out), here - len(inflate.unused_data), wrong


HEAD = re.compile(rb"WARC/1\.[01]\r\n")
LINE = re.compile(rb"([!#-'*+.0-9A-Z^-z|~-]+):[ \t]*(.*?)[ \t]*(?:\r\n|$)", re.S)


def parse_record(data, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers by lower-case name, block and end of the record that begins there."""
    if not HEAD.match(data, at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Damage("headers without end")
    headers = {}
    for line in bytes(data[at:end]).split(b"\r\n")[1:]:
        found = LINE.fullmatch(line)
        if not found:
            raise Damage("bad header line")
        headers[found[1].decode().lower()] = found[2].decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or "warc-type" not in headers or "warc-record-id" not in headers:
        raise Damage("headers lack a length, type or id")
    stop = end + 4 + int(length)
    if bytes(data[stop:stop + 4]) != b"\r\n\r\n":
        raise Damage("record without end")
    block = bytes(data[end + 4:stop])
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated != sha1_label(block):
        raise Damage("block digest differs")
    return headers, block, stop + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    """What stands behind the HTTP headers; revisits have none."""
    if headers["warc-type"] == "revisit":
        return None
    if headers.get("content-type", "").startswith("application/http"):
        block = block.partition(b"\r\n\r\n")[2]
    stated = headers.get("warc-payload-digest", "")
    if stated.startswith("sha1:") and stated != sha1_label(block):
        raise Damage("payload digest differs")
    return block


def records_at(content: bytes, view: memoryview, at: int) -> tuple[list, int, str | None]:
    """The checked records of the member or plain record that begins there, its end, and what is wrong with the rest of it."""
    if not content.startswith(MAGIC, at):
        try:
            headers, block, stop = parse_record(content, at)
            return [(headers, payload_of(headers, block))], stop, None
        except Damage as damage:
            return [], at, str(damage)
    data, stop, wrong = read_member(view, at)
    found, here = [], 0
    while here < len(data):
        try:
            headers, block, here = parse_record(data, here)
            found.append((headers, payload_of(headers, block)))
        except Damage as damage:
            wrong = wrong or str(damage)
            break
    return found, stop, wrong


PLACES = re.compile(re.escape(MAGIC) + rb"|WARC/1\.[01]\r\n")


def salvage(content: bytes) -> Iterator[tuple[int, int, str | None, list]]:
    """(start, stop, reason, records), in order, over all bytes: records that pass their checks, and gaps, which have a reason.

    A gap may have records too: those of a damaged member that came before its damage and pass.
    """
    view, at, size = memoryview(content), 0, len(content)
    while at < size:
        found, stop, wrong = records_at(content, view, at)
        if wrong:
            start, held, stop = at, found, size
            for place in PLACES.finditer(content, at + 1):
                following, after, more = records_at(content, view, place.start())
                if not more or following:
                    stop = place.start()
                    break
            yield start, stop, wrong, held
        elif found:  # an empty member holds nothing
            yield at, stop, None, found
        at = stop


def _salvaged(batches):
    def bare(uri):
        return None if uri is None else uri.strip().removeprefix("<").removesuffix(">")

    def hexed(label):
        """A digest's base-32 label as hex; other digests as they are."""
        return base64.b32decode(label[5:]).hex() if re.fullmatch("sha1:[A-Z2-7]{32}", label or "") else label

    def rows(out):
        kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.binary())
        names = [c.split()[0] for c in FOUND.split(", ")]
        columns = list(zip(*out)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            out, size = [], 0
            for start, stop, gap, found in salvage(content.as_buffer().to_pybytes()):
                if gap is not None:
                    out.append((path.as_py(), start, stop, gap, *[None] * 6))
                for headers, payload in found:
                    out.append((path.as_py(), start, stop, None, headers["warc-type"], bare(headers["warc-record-id"]), bare(headers.get("warc-refers-to")),
                                headers.get("warc-target-uri"), hexed(headers.get("warc-payload-digest")), payload))
                    size += len(payload or b"")
                if size > HANDED or len(out) > 10_000:
                    yield rows(out)
                    out, size = [], 0
            yield rows(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record found and each gap in a folder's archives.

    Gaps have a reason in gap and nothing behind it; start and stop are bytes of the archive, of the
    whole member for records in members. A folder without archives gives no rows.
    """
    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return spark.createDataFrame([], FOUND)
    return files.select("path", "content").mapInArrow(_salvaged, FOUND)


def gaps(found: DataFrame) -> DataFrame:
    """The log of quarantined bytes: archive, start, stop, reason."""
    return found.filter(F.col("gap").isNotNull()).select("archive", "start", "stop", F.col("gap").alias("reason"))


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the page records, revisits with what their responses hold."""
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) AS BIGINT)")
    rows = materialize(found.filter(F.col("record_type").isin("response", "revisit") & F.col("record_id").startswith(ID)).select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "stated_digest",
        "record_type", page("refers_to").alias("refers_to")), "warc-records")
    full = rows.filter("record_type = 'response'")
    asked = rows.filter("record_type = 'revisit'")
    wanted = asked.select(F.col("refers_to").alias("page_id"), "stated_digest").distinct()
    held = (full.join(wanted, ["page_id", "stated_digest"], "left_semi").groupBy(F.col("page_id").alias("refers_to"), "stated_digest")
            .agg(F.max("payload_bytes").alias("_bytes"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1)))))
    again = (asked.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SPLIT)).cast("int")).join(held, ["refers_to", "stated_digest", "part"], "left")
             .select("page_id", F.col("_bytes").alias("payload_bytes"), F.col("stated_digest").alias("payload_digest"), "record_type", "refers_to"))
    return full.select(*again.columns).unionByName(again)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    path = table_path(spark, "warc-archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    result = resolved(read_archives(spark, path))
    remove(spark, path)  # resolved() has written what the archives hold
    return result
