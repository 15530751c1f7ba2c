"""Pages to WARC archives and back: equal payloads become revisits, long records are cut into segments.

Writing: pages whose payload another page with a smaller id has are ``revisit``
records without a payload; the others are ``response`` records, whose payload goes
into the HTTP message in chunked transfer framing. A block longer than
``segment_bytes`` is cut: the first segment keeps the record's type, the others are
``continuation`` records that name their origin and their number, the last one the
total length.

Reading: records that are not segmented go straight on. Segments are grouped by their
origin's identifier, ordered by number, and joined if their numbers run from 1 without
a gap and their bytes come to the total length. Then the chunked framing is decoded,
and the payload held against the digest that its record states. What fails a test
keeps its row, without a payload, and says why in ``problem``. Revisits take length
and digest of the payload from the response they refer to.

A group of equal payloads or of revisits to one page may hold any share of the rows,
see :func:`~tallyframe.llm.common.hot_join`; a segmented record is one row when it is
whole, so its segments meet in one task.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join
from .warc_files import BATCH_BYTES, SCHEMA, WarcSource

#: Bytes of a block from which it is cut into segments, of a chunk of the HTTP body, and of an archive.
SEGMENT_BYTES, CHUNK_BYTES, ARCHIVE_BYTES = 32 << 10, 8 << 10, 64 << 20

_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PAGE, REFERS, URL = "page-id", "refers-to-page-id", "warc-target-uri"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC files state it."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        chunk = payload[at : at + size]
        parts += [b"%x\r\n" % len(chunk), chunk, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of chunked framing; chunk extensions and trailers are passed over, broken framing raises ``ValueError``."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk without a size line")
        size = body[at:end].split(b";")[0].strip()
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            raise ValueError(f"no chunk size: {size[:20]!r}")
        length, at = int(size, 16), end + 2
        if not length:
            while (end := body.find(b"\r\n", at)) > at:  # trailers
                at = end + 2
            if end != at or end + 2 != len(body):
                raise ValueError("chunked body does not end after its last chunk")
            return b"".join(parts)
        if body[at + length : at + length + 2] != b"\r\n":
            raise ValueError("chunk does not end where its size says")
        parts.append(body[at : at + length])
        at += length + 2


def http_payload(block: bytes) -> bytes:
    """The decoded body of an HTTP response."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise ValueError("no HTTP response")
    fields = {n.strip().lower(): v.strip().lower() for n, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"identity") == b"chunked":
        return unchunked(body)
    if int(fields.get(b"content-length", len(body))) != len(body):
        raise ValueError("body is not as long as its Content-Length")
    return body


def decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): pages with the smallest id of an equal payload, null for responses.

    Payloads are the texts in UTF-8, null counting as empty, and equal if their
    SHA-256 digests are. Payloads under ``least_bytes`` are all responses, and so are
    rows that repeat the smallest id; a null id comes after all others.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("equal"))
    groups = rows.groupBy("equal").agg(F.min("page_id").alias("least"), F.min_by("url", "page_id").alias("its_url"), F.count(F.lit(1)).alias("n"))
    both = hot_join(rows, groups, "equal", "page_id")
    again = (F.octet_length("payload") >= least_bytes) & F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least"))
    return both.select("page_id", "url", "payload", F.when(again, F.col("least")).alias("refers_to"), F.when(again, F.col("its_url")).alias("refers_url"))


def _segments(kind: str, fields: list[tuple[str, str]], block: bytes, size: int) -> Iterator[tuple]:
    """The record, or its segments, as rows (kind, record_id, fields, block)."""
    origin = f"<urn:uuid:{uuid.uuid4()}>"
    if len(block) <= size:
        yield kind, origin, fields, block
        return
    last = -(-len(block) // size)
    for number in range(1, last + 1):
        part = block[(number - 1) * size : number * size]
        told = [("WARC-Segment-Number", str(number)), ("WARC-Block-Digest", f"sha1:{digest(part)}")]
        if number == 1:
            yield kind, origin, [*fields, *told], part
            continue
        told.append(("WARC-Segment-Origin-ID", origin))
        if number == last:
            told.append(("WARC-Segment-Total-Length", str(len(block))))
        yield "continuation", f"<urn:uuid:{uuid.uuid4()}>", told, part


def records(decided: DataFrame, date: str = "1970-01-01T00:00:00Z", segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(kind, record_id, fields, block): the WARC records of :func:`decisions`, segments as rows of their own."""
    types = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
    batch = lambda held: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["kind", "record_id", "fields", "block"])

    def build(batches):
        held, size = [], 0
        for b in batches:
            for k in range(b.num_rows):
                page, url, payload, refers, its_url = (b.column(c)[k].as_py() for c in range(5))
                fields = [("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
                fields += [(name, str(v)) for name, v in (("WARC-Target-URI", url), ("Page-Id", page), ("Refers-To-Page-Id", refers), ("WARC-Refers-To-Target-URI", its_url)) if v is not None]
                if refers is None:
                    rows = _segments("response", fields, _HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes), segment_bytes)
                else:
                    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    rows = _segments("revisit", [*fields, profile], _HEAD + b"\r\n", segment_bytes)
                for row in rows:
                    held.append(row)
                    size += len(row[3]) + 512
                    if size >= BATCH_BYTES:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    return decided.select("page_id", "url", "payload", "refers_to", "refers_url").mapInArrow(build, "kind string, record_id string, fields map<string,string>, block binary")


def write(rows: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Records into archives of about ``archive_bytes`` under ``path``, added to those that are there."""
    spark = rows.sparkSession
    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").option("archive_bytes", str(archive_bytes)).save(path)


def read(spark: SparkSession, path: str, segments: str = "all") -> DataFrame:
    """The records of all archives under ``path`` that were committed: archive, kind, record_id, fields (lower-case names), block."""
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(SCHEMA).option("segments", segments).load(path)


def reassembled(segments: DataFrame) -> DataFrame:
    """(kind, record_id, fields, block, problem): segmented records made whole.

    Segments group by their origin's identifier and are joined in the order of their
    numbers; ``problem`` says what is missing: the first segment, a number, the last
    segment, or bytes of the total length. A segment read twice counts once.
    """
    number = F.col("fields")["warc-segment-number"].try_cast("int")
    origin = F.coalesce(F.col("fields")["warc-segment-origin-id"], F.col("record_id"))
    rows = segments.select(
        origin.alias("origin"),
        F.struct(number.alias("number"), "block").alias("segment"),
        F.col("fields")["warc-segment-total-length"].try_cast("long").alias("total"),
        F.when((number == 1) & (F.col("kind") != "continuation"), F.struct("kind", "fields")).alias("first"),
    )
    grouped = rows.groupBy("origin").agg(F.array_sort(F.collect_set("segment")).alias("s"), F.max("total").alias("total"), F.first("first", ignorenulls=True).alias("first"))
    joined = F.aggregate("s", F.lit(b""), lambda whole, s: F.concat(whole, s["block"]))
    numbers = F.transform("s", lambda s: s["number"])
    problem = (
        F.when(F.col("first").isNull(), "no first segment")
        .when(~numbers.eqNullSafe(F.sequence(F.lit(1), F.size("s"))), "segments are missing")
        .when(F.col("total").isNull(), "no last segment")
        .when(F.octet_length("block") != F.col("total"), "segments do not come to the total length")
    )
    whole = grouped.withColumn("block", joined).withColumn("problem", problem)
    return whole.select("first.kind", F.col("origin").alias("record_id"), "first.fields", "block", "problem")


def decoded(whole: DataFrame, payloads: bool = True) -> DataFrame:
    """(kind, record_id, fields, payload, payload_bytes, payload_digest, problem) of whole records (kind, record_id, fields, block, problem).

    Payloads of responses are decoded and held against the digest that the record
    states, if it does; other records have none. ``payloads`` false leaves the bytes out.
    """
    names = ["kind", "record_id", "fields", "payload", "payload_bytes", "payload_digest", "problem"]

    def run(batches):
        for b in batches:
            found = []
            for k in range(b.num_rows):
                kind, block, problem, stated = b.column(0)[k].as_py(), b.column(3)[k].as_py(), b.column(4)[k].as_py(), b.column(5)[k].as_py()
                payload = None
                if kind == "response" and problem is None:
                    try:
                        payload = http_payload(block)
                        if stated and stated.removeprefix("sha1:") != digest(payload):
                            payload, problem = None, "payload has another digest"
                    except ValueError as broken:
                        problem = str(broken)
                found.append((payload if payloads else None, None if payload is None else len(payload), None if payload is None else digest(payload), problem))
            columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.binary(), pa.int64(), pa.string(), pa.string()))] if found else [pa.array([], t) for t in (pa.binary(), pa.int64(), pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=names)

    rows = whole.select("kind", "record_id", "fields", "block", "problem", F.col("fields")["warc-payload-digest"].alias("stated"))
    return rows.mapInArrow(run, "kind string, record_id string, fields map<string,string>, payload binary, payload_bytes long, payload_digest string, problem string")


def contents(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """What :func:`decoded` says of every record of the archives under ``path``, segmented ones made whole."""
    none = F.lit(None).cast("string").alias("problem")
    whole = read(spark, path, "none").select("kind", "record_id", "fields", "block", none)
    return decoded(whole.unionByName(reassembled(read(spark, path, "only"))), payloads)


def pages_of(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem), one row for each page's record of :func:`contents`.

    A revisit has the payload of the response it refers to; none such, or one with
    another digest than the revisit states, is its ``problem``.
    """
    name = lambda field: F.col("fields")[field]
    stated = F.regexp_replace(name("warc-payload-digest"), "^sha1:", "")
    rows = cut(
        found.select(
            name(PAGE).cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", name(REFERS).cast("long")).alias("refers_to"), stated.alias("stated"), "problem"
        )
    )
    rows = rows.where(F.col("record_type").isin("response", "revisit") | F.col("problem").isNotNull())
    target = rows.where("record_type = 'response' and problem is null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("stated")).agg(F.max("payload_bytes").alias("its_bytes"))
    wanted = rows.where("record_type = 'revisit'").groupBy("refers_to", "stated").agg(F.count(F.lit(1)).alias("n"))
    target = target.join(wanted, ["refers_to", "stated"]).select(F.struct("refers_to", "stated").alias("at"), "its_bytes", "n")
    again = hot_join(rows.where("record_type = 'revisit'").withColumn("at", F.struct("refers_to", "stated")), target, "at", "page_id")
    lost = F.when(F.col("its_bytes").isNull(), "no such response").otherwise(F.col("problem"))
    again = again.select("page_id", F.col("its_bytes").alias("payload_bytes"), F.when(F.col("its_bytes").isNotNull(), F.col("stated")).alias("payload_digest"), "record_type", "refers_to", lost.alias("problem"))
    rest = rows.where("record_type is null or record_type <> 'revisit'")
    return rest.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem").unionByName(again)
