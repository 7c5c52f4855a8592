import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from loglathe.llm import queries, warc

SCHEMA = "page_id long, url string, html string, path string, digest string"


def _rows():
    r = random.Random(1)
    rows = [(i, f"http://x/{i} a\r\nb", "é" * r.randint(0, 40) + r.choice(["", "a", "\r\n\r\nWARC/1.1\r\n"]), "p", "d") for i in range(300)]
    rows += [(1000 + i, None, "same page", "p", "d") for i in range(50)]
    rows += [(2000, "http://y", None, "p", "d"), (2001, "http://y", "", "p", "d"), (2002, "u", "x" * 3_000_000, "p", "d")]
    r.shuffle(rows)
    return rows


def _want(rows):
    first = {}
    for i, _, html, *_ in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    out = {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        refers = first[html or ""]
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers == i else "revisit", None if refers == i else refers)
    return out


def test_round_trip(spark):
    rows = _rows()
    index = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(6))
    got = warc.read(index).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == _want(rows)
    html = {i: (h or "").encode() for i, _, h, *_ in rows}
    assert all(bytes(r.payload) == html[r.page_id] for r in got if r.record_type == "response")
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_selected_records_and_rebuilt_index(spark):
    index = warc.write(spark.createDataFrame(_rows(), SCHEMA))
    some = warc.read(index.where(F.col("page_id") % 7 == 0)).collect()
    assert {r.page_id for r in some} == {i for i, *_ in _rows() if i % 7 == 0}
    again = warc.scan(index.select("path").distinct())
    assert sorted(map(tuple, again.drop("url").collect())) == sorted(map(tuple, index.drop("url").collect()))
    path = index.first().path.removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")  # readable by any gzip tool


def test_ranges_are_joined():
    near = [(0, 10), (10, 5), (15 + warc.GAP_BYTES, 5), (30 + 2 * warc.GAP_BYTES, 1)]
    assert [(a, b, len(x)) for a, b, x in warc.ranges(near)] == [(0, 20 + warc.GAP_BYTES, 3), (near[3][0], near[3][0] + 1, 1)]
    assert list(warc.ranges([])) == []
    assert len(list(warc.ranges([(i * 1000000, 1000000) for i in range(20)]))) == 3


def test_one_task_writes_all(spark):
    rows = [(i, "u", f"{i}" * 50, "", "") for i in range(40)]
    index = warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1))
    assert warc.read(index).count() == 40


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, "a", "", ""), (None, "u", "a", "", ""), (5, "u", "b", "", ""), (5, "u", "b", "", ""), (None, "u", "b", "", "")]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in warc.read(warc.write(spark.createDataFrame(rows, SCHEMA))).collect())
    assert got == [(0, "response", 0), (0, "response", 0), (0, "revisit", 5), (5, "response", 0), (5, "response", 0)]
    assert warc.read(warc.write(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_over_the_table(spark):
    got = queries.QUERIES["op10_warc"](spark, "/root/testdata/sf0.001")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    want = _want([(p.page_id, p.url, p.html) for p in pages])
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()} == want
