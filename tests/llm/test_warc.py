import base64
import gzip
import hashlib
import io
import uuid

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import warc, warc_files
from tallyframe.llm.common import checkpoint_dir, hot_join

PAGES = "page_id long, url string, html string"


def there_and_back(spark, pages, least_bytes=0, archive_bytes=1 << 20, **sizes):
    where = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(warc.records(warc.decisions(pages, least_bytes=least_bytes), **sizes), where, archive_bytes)
    return where, warc.pages_of(warc.contents(spark, where))


def plain(found):
    order = lambda r: tuple((v is None, v) for v in r)
    return sorted((tuple(r) for r in found.collect()), key=order)


def brute(rows, least_bytes=0):
    out = []
    for i, _, t in rows:
        payload = (t or "").encode()
        same = [j for j, _, s in rows if (s or "") == (t or "") and j is not None]
        again = bool(same) and i != min(same) and len(payload) >= least_bytes
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", min(same) if again else None, None))
    return sorted(out, key=lambda r: tuple((v is None, v) for v in r))


def test_pages_there_and_back(spark):
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\n0\r\n\r\n"
    rows = [(3, "http://a/ b", "x" * 1000), (1, None, "x" * 1000), (2, "u", None), (4, "u", ""), (None, "u", ""), (None, None, "alone"), (5, "u", odd), (6, "line\r\nX: y", odd * 99), (7, "ü", "é€😀" * 500), (7, "ü", "é€😀" * 500), (9, "u", "é€😀" * 500)]
    pages = spark.createDataFrame(rows, PAGES).select("*", F.lit("x").alias("payload"), F.lit(1).alias("n"), F.lit(2).alias("equal"))
    for sizes in ({}, {"segment_bytes": 97, "chunk_bytes": 13}, {"segment_bytes": 1, "chunk_bytes": 7}):
        for least in (0, 1, 1001):
            assert plain(there_and_back(spark, pages.repartition(3), least, **sizes)[1]) == brute(rows, least)


def test_one_payload_on_half_of_the_pages(spark):
    rows = [(k, f"u{k}", "same page" if k % 2 else f"page {k}") for k in range(400)]
    where, found = there_and_back(spark, spark.createDataFrame(rows, PAGES).repartition(4), archive_bytes=4000)
    assert plain(found) == brute(rows)
    assert warc.read(spark, where).select("archive").distinct().count() > 4


def test_long_page_and_empty_table(spark):
    rows = [(1, "u", "long page " * 500_000), (2, "u", "long page " * 500_000)]
    assert plain(there_and_back(spark, spark.createDataFrame(rows, PAGES))[1]) == brute(rows)
    assert there_and_back(spark, spark.createDataFrame([], PAGES))[1].collect() == []


def test_archives_are_plain_warc(spark):
    where, _ = there_and_back(spark, spark.createDataFrame([(1, "http://a/", "payload")], PAGES))
    names = [r.archive for r in warc.read(spark, where).collect()]
    text = gzip.open(f"{where.removeprefix('file:')}/{names[0]}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"7\r\npayload\r\n0\r\n\r\n\r\n\r\n")
    (fields, block), = warc_files.records_in(io.BytesIO(text))
    assert fields["warc-target-uri"] == "http://a/" and int(fields["content-length"]) == len(block)
    for broken in (text[:-20], b"junk\r\n" + text, text.replace(b"Content-Length", b"Length")):
        with pytest.raises(ValueError):
            list(warc_files.records_in(io.BytesIO(broken)))


def test_a_task_that_fails_leaves_nothing(spark):
    where = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    good = warc.records(warc.decisions(spark.createDataFrame([(1, "u", "good")], PAGES)))
    warc.write(good, where)
    bad = good.unionByName(good.withColumn("record_id", F.raise_error(F.lit("lost")).cast("string")))
    with pytest.raises(Exception, match="lost"):
        warc.write(bad, where)
    assert [r.page_id for r in warc.pages_of(warc.contents(spark, where)).collect()] == [1]
    warc.write(good, where)
    assert warc.read(spark, where).count() == 2


def test_chunked_framing():
    for size in (1, 3, 100):
        for payload in (b"", b"a", b"0\r\n\r\n" * 9, bytes(range(256))):
            assert warc.unchunked(warc.chunked(payload, size)) == payload
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"z\r\n", b"-1\r\n\r\n", b"0\r\n", b"0\r\n\r\nmore", b"4\r\nabc\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab") == b"ab"
    for broken in (b"ab", b"HTTP/1.1 200 OK\r\nContent-Length: 3\r\n\r\nab"):
        with pytest.raises(ValueError):
            warc.http_payload(broken)


def test_segments_are_verified(spark):
    def segment(origin, number, block, total=None, first=False):
        fields = {"warc-segment-number": str(number)} | ({} if first else {"warc-segment-origin-id": origin}) | ({"warc-segment-total-length": str(total)} if total is not None else {})
        return ("response" if first else "continuation", origin if first else f"{origin}-{number}", fields, bytearray(block))

    rows = [
        segment("whole", 3, b"c", 3), segment("whole", 1, b"a", first=True), segment("whole", 2, b"b"), segment("whole", 2, b"b"),
        segment("headless", 2, b"b", 2), segment("gap", 1, b"a", first=True), segment("gap", 3, b"c", 3), segment("open", 1, b"a", first=True), segment("open", 2, b"b"),
        segment("short", 1, b"a", first=True), segment("short", 2, b"b", 9), segment("twofold", 1, b"a", first=True), segment("twofold", 2, b"b", 2), segment("twofold", 2, b"x", 2),
    ]
    frame = spark.createDataFrame(rows, "kind string, record_id string, fields map<string,string>, block binary").repartition(5)
    found = {r.record_id: r for r in warc.reassembled(frame).collect()}
    assert bytes(found["whole"].block) == b"abc" and found["whole"].problem is None and found["whole"].kind == "response"
    assert {k: r.problem for k, r in found.items() if k != "whole"} == {
        "headless": "no first segment", "gap": "segments are missing", "open": "no last segment", "short": "segments do not come to the total length", "twofold": "segments are missing",
    }


def test_problems_are_told(spark):
    rows = [(1, "u", "one"), (2, "u", "one"), (3, "u", "three")]
    records = warc.records(warc.decisions(spark.createDataFrame(rows, PAGES)))
    kind, where = F.col("fields")["Page-Id"], f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    broken = records.where(kind != "1").withColumn("block", F.when(kind == "3", F.encode(F.replace(F.decode("block", "utf-8"), F.lit("three"), F.lit("threx")), "utf-8")).otherwise(F.col("block")))
    warc.write(broken, where)
    assert {r.page_id: (r.payload_bytes, r.problem) for r in warc.pages_of(warc.contents(spark, where)).collect()} == {2: (None, "no such response"), 3: (None, "payload has another digest")}


def test_hot_join_is_a_left_join(spark):
    rows = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k % 9}") for k in range(90)] + [(90, None), (91, "none")], "id long, at string")
    table = rows.where("at <> 'none'").groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    found = hot_join(rows, table, "at", "id")
    assert found.columns == ["id", "at", "least"]
    least = {r["at"]: r.least for r in table.collect()}
    assert {r.id: r.least for r in found.collect()} == {r.id: least.get(r["at"]) for r in rows.collect()}
