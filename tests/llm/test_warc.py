import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import warc

PAGES = [(5, "http://a/1", "<p>é😀</p>"), (2, "http://a/2", "<p>é😀</p>"), (9, None, None), (3, "http://b\r\nX: y", ""), (7, "http://a/1", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "u", "<p>" + "long " * 60_000), (4, "u", "<p>" + "long " * 60_000), (None, "u", "no id")]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, key int").repartition(3)


def test_contract(spark, pages, folder):
    got = {r.page_id: r for r in warc.op5_warc(spark, folder(pages=pages)).collect()}
    assert len(got) == len(PAGES)
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            body = (html or "").encode()
            first[body] = min(first.get(body, i), i)
    for i, _, html in PAGES:
        body, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if i is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if first[body] == i else ("revisit", first[body]))


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip_and_pushdown(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/w"
    warc.archive(pages, path, compression=compression)
    whole = warc.read(spark, path)
    assert whole.count() == len(PAGES)
    text = {r.record_id: bytes(r.payload).decode() for r in whole.where("warc_type = 'response'").collect()}
    assert text["urn:page:2"] == "<p>é😀</p>" and text["urn:page:7"].startswith("WARC/1.1")
    revisits = whole.where((F.col("warc_type") == "revisit") & F.col("record_id").isin("urn:page:5", "urn:page:9"))
    assert [(r.record_id, r.refers_to, r.payload) for r in sorted(revisits.collect())] == [("urn:page:5", "urn:page:2", None), ("urn:page:9", "urn:page:3", None)]
    uris = {r.record_id: r.target_uri for r in warc.read(spark, path, "record_id string, target_uri string").collect()}
    assert uris["urn:page:3"] == "http://b%0D%0AX: y" and uris["urn:page:9"] is None


def test_unwanted_payloads_are_not_read():
    """A record that the predicate rejects is passed over without its bytes being decoded."""
    import io

    good, bad = warc.record("a", "response", "u", None, b"x" * 10), warc.record("b", "response", "u", None, b"y" * 100_000)

    class Counting(io.BytesIO):
        got = 0

        def read(self, n=-1):
            data = super().read(n)
            Counting.got += len(data)
            return data

    rows = list(warc.records(Counting(bad + good), ["record_id", "payload"], [("record_id", frozenset(["a"]))]))
    assert rows == [("a", b"x" * 10)] and Counting.got <= 10
    with pytest.raises(ValueError, match="digest"):
        list(warc.records(io.BytesIO(good.replace(b"x" * 10, b"x" * 9 + b"z")), ["payload"]))


def test_foreign_archives(spark, tmp_path):
    """Folded headers, other record types and gzip members, without a manifest."""
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Type: application/warc-fields\r\nX-Long: a\r\n  b\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(warc.record("r", "response", "u", None, b"body")))
    (tmp_path / "b.warc").write_bytes(info)
    got = warc.read(spark, f"file://{tmp_path}", "record_id string, warc_type string, payload binary, payload_bytes long").collect()
    assert sorted((r.record_id, r.warc_type, bytes(r.payload), r.payload_bytes) for r in got) == [("i", "warcinfo", b"a: b", 4), ("i", "warcinfo", b"a: b", 4), ("r", "response", b"body", 4)]


def test_empty_and_hot(spark, tmp_path, folder):
    schema = "page_id long, url string, html string"
    assert warc.op5_warc(spark, folder(pages=spark.createDataFrame([], schema))).count() == 0
    same = spark.range(2000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("<p>same</p>").alias("html"))
    warc.archive(same, f"file://{tmp_path}/hot")
    kinds = {r.warc_type: r["count"] for r in warc.read(spark, f"file://{tmp_path}/hot", "warc_type string").groupBy("warc_type").count().collect()}
    assert kinds == {"response": 1, "revisit": 1999}


def test_damaged_records(spark, tmp_path):
    """They end the job with the file's name, or in permissive mode have no payload, and the records after them are read."""
    good = [warc.record(f"urn:{k}", "response", None, None, f"text {k}".encode()) for k in range(4)]
    damaged = good[0] + good[1].replace(b"text 1", b"text X") + good[2].replace(b"Content-Length: ", b"Content-Size: ") + b"\r\nsome noise\r\n" + good[3]
    (tmp_path / "a.warc").write_bytes(damaged)
    warc.register(spark)
    load = lambda mode: spark.read.format("sparrowmill_warc").option("mode", mode).load(f"file://{tmp_path}").select("record_id", "payload").collect()
    got = {r.record_id: bytes(r.payload) if r.payload is not None else None for r in load("permissive")}
    assert got == {"urn:0": b"text 0", "urn:1": None, "urn:2": None, "urn:3": b"text 3"}
    with pytest.raises(Exception, match="a.warc"):
        load("failfast")
