"""Archive files of others, and the smallest id in every operator that deals rows anew."""

import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tallymere.llm import ngram_join, queries, warc
from tallymere.llm.components import components

LEAST = -(2**63)


def record(block: bytes, *lines: str, version="1.1", length=None) -> bytes:
    head = "\r\n".join([f"WARC/{version}", *lines, f"Content-Length: {len(block) if length is None else length}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


HTTP = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
TYPE = "Content-Type: application/http; msgtype=response"


def read(spark, tmp_path, **files):
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(gzip.compress(data))
    return warc.import_warc(spark, f"file://{tmp_path}")


def test_files_of_other_writers(spark, tmp_path):
    odd = bytes(range(256)) * 3
    one = record(b"software: y\r\n", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", version="1.0")
    one += record(HTTP + odd, "warc-type: response", "WARC-Page-ID: <urn:page:5>", "WARC-Target-URI:http://a/b", TYPE, version="1.0").replace(b"Content-Length", b"content-length")
    one += record(HTTP + b"text WARC/1.0\r\nContent-Length: 1\r\n\r\nz", "WARC-Type: response", "WARC-Page-ID: <urn:page:6>", TYPE, "WARC-Payload-Digest: sha1:ABC")
    rows = read(spark, tmp_path, one=one)
    assert rows.where("error is not null").count() == 0
    got = {r["id"]: r for r in warc.parsed(rows).collect()}
    assert bytes(got[5]["content"]) == odd and got[5]["payload"] is None and got[5]["url"] == "http://a/b"
    assert got[5]["payload_digest"] == hashlib.sha256(odd).hexdigest() and got[5]["payload_bytes"] == len(odd)
    assert got[6]["payload"] == "text WARC/1.0\r\nContent-Length: 1\r\n\r\nz"
    assert got[None]["record_type"] == "warcinfo" and got[None]["payload"] == "software: y\r\n"


def test_bad_records_are_named_and_others_read(spark, tmp_path):
    good = lambda k: record(b"block %d" % k, "WARC-Type: response", f"WARC-Record-ID: <urn:uuid:{k}>")
    cut = record(b"short", "WARC-Type: response", "WARC-Record-ID: <urn:uuid:cut>", length=90)
    files = {
        "a": good(1) + cut + good(2) + good(3), "b": good(4) + cut, "c": record(b"longer", "WARC-Record-ID: <urn:uuid:long>", length=2) + good(5),
        "d": b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:head>\r\n" + good(6), "e": b"WARC/1.1\r\nWARC-Record-ID: <urn:uuid:none>\r\n\r\nx\r\n\r\n" + good(7), "f": b"", "g": b"no archive at all",
    }
    rows = read(spark, tmp_path, **files).select("header", F.col("block").cast("string").alias("block"), "error").collect()
    assert sorted(r["block"] for r in rows if r["error"] is None) == [f"block {k}" for k in range(1, 8)]
    errors = sorted((r["error"].split(" in ")[0], r["error"].split(", ")[-1]) for r in rows if r["error"])
    assert errors == sorted([
        ("a record ends inside its block", "<urn:uuid:cut>"), ("a record ends inside the file", "<urn:uuid:cut>"), ("a record longer than its Content-Length", "<urn:uuid:long>"),
        ("a record ends inside its header", "<urn:uuid:head>"), ("a record without Content-Length", "<urn:uuid:none>"), ("a record without a version line", "without an id"),
    ])
    with pytest.raises(Exception, match="a record "):
        warc.parsed(warc.import_warc(spark, f"file://{tmp_path}")).collect()


def test_smallest_id(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(LEAST, text), (3, text + " more"), (4, text + " most"), (9, "else"), (LEAST + 1, None)], "doc_id bigint, text string")
    assert {r[0]: r[2] for r in ngram_join.ngram_groups(docs, n=4, percent=85).collect()} == {LEAST: LEAST, 3: LEAST, 4: LEAST, 9: 9, LEAST + 1: LEAST + 1}
    assert {r[0] for r in ngram_join.drop_near_duplicates(docs).collect()} == {LEAST, 9, LEAST + 1}
    edges = spark.createDataFrame([(5, LEAST), (5, 7), (7, 2**63 - 1)], "a bigint, b bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(k, LEAST) for k in (5, 7, 2**63 - 1, LEAST)}
    pages = spark.createDataFrame([(LEAST, "u", "p" * 200), (1, "u", "p" * 200), (2, "v", None)], "page_id bigint, url string, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in queries.op5_warc(spark, str(tmp_path)).collect()}
    assert got == {LEAST: ("response", None), 1: ("revisit", LEAST), 2: ("response", None)}


def test_chat_sql_counts_backslashes(spark, tmp_path):
    rows = [(1, 0, "user", "a\\b"), (1, 1, "assistant", "\\\\ </s>"), (2, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    built = queries.op3_chat_formatting(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op3_chat_formatting"])
    at = [rel.columns.index(c) for c in built.columns]
    assert sorted(tuple(r[k] for k in at) for r in rel.fetchall()) == sorted(tuple(r) for r in built.collect())
