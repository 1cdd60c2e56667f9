"""WARC: exact round trip, revisits, ranged reads of a selection."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from seriesloom.llm.shared import new_path
from seriesloom.llm.warc import coalesce, parse, read, record, round_trip, write

ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>two</p>"), (3, None, "<p>one</p>"), (4, "http://a/4", None), (5, "http://a/5", ""), (6, "http://x\r\ny", "é\r\n\r\nWARC/1.1"), (None, "http://n", "<p>one</p>"), (7, "http://a/7", "z" * 300000), (2, "http://a/2", "<p>two</p>")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(3)
    rows = round_trip(pages.withColumn("file", F.lit("x")).withColumn("payload", F.lit(7))).collect()
    got = {(r.page_id, r.payload_digest): r for r in rows if (r.page_id, r.refers_to) != (2, 2)}
    assert len([r for r in rows if r.page_id == 2]) == 2 and len([r for r in rows if r.page_id == 2 and r.record_type == "revisit" and r.refers_to == 2]) == 1
    first = {}
    for i, _, html in sorted((r for r in ROWS if r[0] is not None)):
        first.setdefault(html or "", i)
    for i, _, html in ROWS:
        data = (html or "").encode()
        r = got[i, base64.b32encode(hashlib.sha1(data).digest()).decode()]
        again = i is not None and first[html or ""] != i
        assert (r.payload_bytes, r.record_type, r.refers_to, r.intact) == (len(data), "revisit" if again else "response", first[html or ""] if again else None, True)
    assert len(rows) == len(ROWS)


def test_selection_by_index(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    folder = new_path(spark, "warc-test")
    index = write(pages, folder, roll_bytes=500)
    assert index.select("file").distinct().count() > 2
    got = read(index.where("page_id in (1, 6)"), folder).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {1: "<p>one</p>", 6: "é\r\n\r\nWARC/1.1"}


def test_members_are_gzip_and_reads_merge():
    member = record(3, "u", b"body", None)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and parse(member)["payload"] == b"body"
    assert coalesce([(0, 10), (10, 5), (100, 5), (5000, 1)], gap=100, most=1000) == [(0, 105, 3), (5000, 5001, 1)]
    assert coalesce([(0, 900), (900, 900)], gap=100, most=1000) == [(0, 900, 1), (900, 1800, 1)]


def test_a_hot_repeated_page_has_one_response(spark):
    pages = spark.createDataFrame([(9, f"u{i}", "same") for i in range(300)] + [(4, "v", "same"), (12, "w", "other")], "page_id long, url string, html string")
    got = round_trip(pages.repartition(5)).groupBy("page_id", "record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got), key=str) == [(12, "response", None, 1), (4, "response", None, 1), (9, "revisit", 4, 300)]
    got = round_trip(pages.where("page_id = 9")).groupBy("record_type", "refers_to").count().collect()
    assert sorted(map(tuple, got), key=str) == [("response", None, 1), ("revisit", 9, 299)]


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("limit", [0, 100_000])
def test_both_joins(spark, limit):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    index = write(pages, new_path(spark, "warc-join"), broadcast_rows=limit)
    assert index.where("record_type = 'revisit'").count() == 3
