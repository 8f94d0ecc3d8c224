import hashlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, table
from tidemark.llm.registry import op4_warc
from tidemark.llm.warc import chunked, page_of, parse, read_records, read_warc, record, unchunked, write_warc

PAGES = "page_id long, url string, html string"


def test_query_round_trip(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in table(spark, sf_dir, "pages").collect()}
    leader = {}
    for i, body in pages.items():
        leader[body] = max(i, leader.get(body, i))
    want = {}
    for i, body in pages.items():
        again = len(body) >= 1000 and leader[body] != i
        want[i] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", leader[body] if again else None)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in op4_warc(spark, sf_dir).collect()}
    assert got == want


def test_segments_revisits_and_edges(spark):
    tricky = "WARC/1.1\r\n\r\n\r\n0\r\n\r\n" * 200
    rows = [(1, "http://a/é", "ü€𝄞" * 90_000), (2, None, tricky), (3, "http://b\r\nX: y", tricky), (4, "u", None), (5, "u", ""), (6, "u", "s" * 999), (7, "u", "s" * 999),
            (8, "u", "t" * 1000), (8, "u", "t" * 1000), (9, "u", "t" * 1000), (None, "u", "t" * 1000), (1, "http://a/é", "ü€𝄞" * 90_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"digest": F.lit(1), "page": F.lit(2), "leader": F.lit(3)})
    path = new_path(spark, "warc")
    write_warc(pages, path, segment_bytes=4096)
    assert read_records(spark, path).where("record_type = 'continuation'").count() > 100
    got = sorted(((r["page"], r["record_type"], r["refers"], None if r["payload"] is None else bytes(r["payload"]).decode(), r["payload_bytes"], r["error"]) for r in read_warc(spark, path).withColumns({"page": page_of("record_id"), "refers": page_of("refers_to")}).collect()), key=str)
    want = []
    for i, _, html in rows:
        again = (html == tricky and i == 2) or (html == "t" * 1000 and i == 8)
        want.append((i, "revisit" if again else "response", {2: 3, 8: 9}[i] if again else None, None if again else html or "", len((html or "").encode()), None))
    assert got == sorted(want, key=str)


def test_empty_table(spark):
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame([], PAGES), path)
    assert read_warc(spark, path).count() == 0


def test_broken_archives_are_told(spark):
    path = new_path(spark, "warc")
    write_warc(spark.createDataFrame([(1, "u", "x" * 20_000)], PAGES), path, segment_bytes=4096)
    whole = read_records(spark, path).where("segment <> 3")
    assert whole.count() == 4
    with pytest.raises(ValueError):
        unchunked(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(parse(record([("WARC-Type", "response")], b"abc")[:-1]))
    assert unchunked(chunked(b"a" * 20_000, 999)) == b"a" * 20_000
