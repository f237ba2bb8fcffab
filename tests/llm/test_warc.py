import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tickwise.llm import queries, warc
from tickwise.session import fresh_path
from tickwise.sources.tables import read

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def table(spark, tmp_path):
    def make(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "pages.parquet"))
        return str(tmp_path)

    return make


def check(rows, pages):
    holder = {}
    for r in pages:
        holder[digest(r[2])] = max(r[0], holder.get(digest(r[2]), r[0]))
    want = {}
    for i, _, html in pages:
        first = holder[digest(html)]
        want[i] = (len((html or "").encode()), digest(html), "response" if i == first else "revisit", None if i == first else first)
    assert {r.page_id: tuple(r)[1:5] for r in rows} == want
    assert all((r.n_requests, r.n_metadata) == (1, 1) for r in rows)


def test_all_pages(spark):
    pages = [tuple(r) for r in read(spark, FOLDER, "pages").select("page_id", "url", "html").collect()]
    rows = queries.warc_transactions(spark, FOLDER).collect()
    assert len(rows) == len(pages)
    check(rows, pages)


def test_odd_payloads(spark, table):
    pages = [
        (1, "http://a/", "same"), (2, "http://b/", "same"), (9, None, "same"), (3, "http://c/\r\nX: 1", None), (4, "", ""),
        (5, "u", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1."),
        (6, "u", "é中\n\x00﻿" * 1000), (7, "u", "WARC/1." * 500), (8, "u", "\r\n\r\n\r\n"), (10, "u", "x" * 3_000_000),
    ]
    folder = table(pages)
    rows = queries.warc_transactions(spark, folder).collect()
    assert len(rows) == len(pages)
    check(rows, pages)


def test_repeated_rows_and_null_ids(spark, table):
    pages = [(1, "a", "x"), (1, "a", "x"), (2, "b", "y"), (None, None, "z"), (None, None, None)]
    rows = queries.warc_transactions(spark, table(pages)).collect()
    assert sorted(str(r.page_id) for r in rows) == ["1", "1", "2", "None", "None"]


def test_no_pages(spark, table):
    assert queries.warc_transactions(spark, table([])).count() == 0


def record(kind, name, block, **headers):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"Content-Length: {len(block)}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, values in headers.items() for v in ([values] if isinstance(values, str) else values)]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    """One gzip member a record, WARC/1.0, links in either direction, a chain, an orphan, many companions, a cut archive."""
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody"
    one = [
        record("warcinfo", "<i>", b"software: x\r\n"),
        record("response", "<r1>", http, WARC_Concurrent_To=["<q1>"], Content_Type="application/http; msgtype=response"),
        record("request", "<q1>", b"GET / HTTP/1.0\r\n\r\n", Content_Type="application/http; msgtype=request"),
        record("metadata", "<m1>", b"a: 1\r\n", WARC_Concurrent_To="<q1>"),
        record("request", "<q9>", b"GET /9 HTTP/1.0\r\n\r\n", WARC_Concurrent_To="<nowhere>"),
    ]
    two = [record("resource", "<r2>", b"plain")] + [record("metadata", f"<m{i}>", b"x", WARC_Concurrent_To="<r2>") for i in range(100, 400)]
    for name, records in (("a", one), ("b", two)):
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", "<r3>", b"cut short")[:-8]))
    records = warc.read_archives(spark, str(tmp_path)).cache()
    assert records.count() == 5 + 301 + 1 and [r.record_id for r in records.filter("truncated").collect()] == ["<r3>"]
    rows = warc.assemble(records).collect()
    by = {}
    for r in rows:
        by.setdefault(r.capture, []).append(r)
    assert set(by) == {"<r1>", "<r2>", "<r3>", "<q9>"}
    (first,) = by["<r1>"]
    assert bytes(first.response.body) == b"body" and first.response.headers.endswith("Server: x")
    assert [x.record_id for x in first.requests] == ["<q1>"] and [x.record_id for x in first.metadata] == ["<m1>"]
    assert by["<q9>"][0].response is None and [x.record_id for x in by["<q9>"][0].requests] == ["<q9>"]
    assert sum(r.response is not None for r in by["<r2>"]) == 1 and len(by["<r2>"]) > 1
    assert sorted(x.record_id for r in by["<r2>"] for x in r.metadata) == sorted(f"<m{i}>" for i in range(100, 400))


def test_archives_are_archives(spark):
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.captures(read(spark, FOLDER, "pages"), "page_id", "url", "html"), path)
    names = [x for x in os.listdir(path) if x.endswith(".gz")]
    data = b"".join(gzip.open(os.path.join(path, x)).read() for x in names)
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: ") and data.endswith(b"\r\n\r\n")
    kinds = {r.type: r["count"] for r in warc.read_archives(spark, path).groupBy("type").count().collect()}
    assert kinds["request"] == kinds["metadata"] == kinds["response"] + kinds.get("revisit", 0)


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "yyyyyy"), (4, "d", "yyyyyy")], SCHEMA)
    path = fresh_path(spark, "test-warc")
    warc.write_archives(warc.captures(df, "page_id", "url", "html", least_bytes=5), path)
    kinds = warc.read_archives(spark, path).filter(F.col("type").isin("response", "revisit"))
    assert sorted((r.record_id, r.type) for r in kinds.collect()) == [
        ("<urn:page:1:response>", "response"), ("<urn:page:2:response>", "response"), ("<urn:page:3:response>", "revisit"), ("<urn:page:4:response>", "response")]


def test_bad_lengths_give_truncated_records(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nContent-Length: many\r\n\r\n"
    rows = [
        record("response", "<r1>", b"HTTP/1.0 200 OK\r\n\r\nbody", Content_Type="application/http").replace(b"Content-Length: 23", b"Content-Length: abc"),
        record("revisit", "<r2>", http, Content_Type="application/http; msgtype=response"),
        record("metadata", "<m1>", b"x", WARC_Concurrent_To="<r1>").replace(b"Content-Length: 1\r\n", b""),
        record("resource", "<r3>", b"whole"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(rows)))
    found = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k for k, r in found.items() if r.truncated} == {"<r1>", "<m1>"} and len(found) == 4
    assert bytes(found["<r1>"].body) == b"body" and bytes(found["<m1>"].body) == b"x" and bytes(found["<r3>"].body) == b"whole"
    assert found["<r2>"].body_bytes == 0


def test_chains_of_any_length_and_types_of_any_name(spark, tmp_path):
    rows = [record("response", "<r>", b"x")] + [record("metadata", f"<m{i}>", b"y", WARC_Concurrent_To=f"<m{i - 1}>" if i else "<r>") for i in range(6)]
    rows += [record("novel", "<n>", b"z", WARC_Concurrent_To="<m5>"), record("request", "<a>", b"q", WARC_Concurrent_To="<b>"), record("request", "<b>", b"q", WARC_Concurrent_To="<a>")]
    rows += [record("warcinfo", "<i>", b"info"), record("novel", "<lost>", b"z")]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(rows)))
    records = warc.read_archives(spark, str(tmp_path)).cache()
    nameless = records.filter("record_id = '<lost>'").withColumns({"record_id": F.lit(None).cast("string"), "type": F.lit(None).cast("string")})
    by = {r.capture: r for r in warc.assemble(records.unionByName(nameless).unionByName(nameless.withColumn("uri", F.lit("u")))).collect()}
    assert set(by) == {"<r>", "<a>", "<b>", "<lost>", None}
    assert sorted(x.record_id for x in by["<r>"].metadata) == sorted([*[f"<m{i}>" for i in range(6)], "<n>"])
    assert [x.record_id for x in by["<a>"].requests] == ["<a>"] and len(by[None].metadata) == 2


def test_plain_archives_are_read_whole(spark, tmp_path):
    """Blocks that hold the mark of a record, in a file that Spark splits."""
    block = b"WARC/1.0 is a mark, and WARC/1.1 another. " * 50
    rows = [record("resource", f"<r{i}>", block + str(i).encode()) for i in range(200)]
    (tmp_path / "a.warc").write_bytes(b"".join(rows))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "20000")
    try:
        found = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(name, before)
    assert len(found) == 200 and not any(r.truncated for r in found.values())
    assert all(bytes(found[f"<r{i}>"].body) == block + str(i).encode() for i in range(200))
