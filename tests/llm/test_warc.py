import base64
import hashlib
import json

import pytest

from alembiq.llm import warc as W

SCHEMA = "page_id long, url string, html string, digest string, holder string, n int"


def rows():
    big = 2**60
    return [
        (big, "http://a", "<p>é</p>", "clash", "clash", 1), (big + 1, "http://b", "<p>é</p>", None, None, 1), (3, None, None, None, None, 1), (4, "http://c", "", None, None, 1),
        (5, "http://d", "x\r\n\r\ny", None, None, 1), (5, "http://d", "x\r\n\r\ny", None, None, 1), (6, "http://e", "z" * 3_000_000, None, None, 1), (None, "http://f", "only", None, None, 1), (None, "http://g", "x\r\n\r\ny", None, None, 1),
    ]


def test_round_trip(spark, tmp_path):
    manifest = W.write_bundles(spark.createDataFrame(rows(), SCHEMA), f"file://{tmp_path}", bundles=2)
    got = sorted((tuple(r) for r in W.read_bundles(spark, manifest).collect()), key=str)
    d = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    big = 2**60
    want = [
        (big, 9, d("<p>é</p>"), "revisit", big + 1), (big + 1, 9, d("<p>é</p>"), "response", None), (3, 0, d(""), "revisit", 4), (4, 0, d(""), "response", None),
        (5, 6, d("x\r\n\r\ny"), "response", None), (5, 6, d("x\r\n\r\ny"), "revisit", 5), (6, 3_000_000, d("z" * 3_000_000), "response", None), (None, 4, d("only"), "response", None), (None, 6, d("x\r\n\r\ny"), "revisit", 5),
    ]
    assert got == sorted(want, key=str)


def test_one_record_by_identifier(spark, tmp_path):
    manifest = W.write_bundles(spark.createDataFrame(rows(), SCHEMA), f"file://{tmp_path}", bundles=1)
    bundle = W.BundleReader(manifest[0]["path"])
    urn = lambda page, text: W.page_urn(page, W.base32_sha1(text.encode()))
    record = bundle.get(urn(6, "z" * 3_000_000))
    assert (record.kind, len(record.payload), record.uri) == ("response", 3_000_000, "http://e")
    assert bundle.get(urn(2**60, "<p>é</p>")).refers_to == urn(2**60 + 1, "<p>é</p>")
    assert bundle.get(urn(3, "")).uri == urn(3, "")
    assert len(bundle.index) == 9 and json.loads(bundle.file.index())


def test_small_payloads_can_be_kept_as_responses(spark, tmp_path):
    manifest = W.write_bundles(spark.createDataFrame(rows(), SCHEMA), f"file://{tmp_path}", least_bytes=7)
    kinds = {(r["page_id"], r["record_type"]) for r in W.read_bundles(spark, manifest).collect()}
    assert (3, "response") in kinds and (2**60, "revisit") in kinds


def test_empty_table(spark, tmp_path):
    manifest = W.write_bundles(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}")
    assert manifest == [] and W.read_bundles(spark, manifest).count() == 0


def test_records_are_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        W.Record.parse(b"HTTP/1.1 200 OK\r\n\r\n")


def test_urls_that_are_no_headers(spark, tmp_path):
    urls = ["http://a/x\r\nWARC-Type: warcinfo\r\n\r\n", "http://a/b c\t\x00\x7f", "", ": ", "http://a/é\u2028\xa0", "\r\n"]
    table = [(i, u, f"page {i // 2}", None, None, 1) for i, u in enumerate(urls)]
    manifest = W.write_bundles(spark.createDataFrame(table, SCHEMA), f"file://{tmp_path}", bundles=1)
    found = {W.page_of(r.record_id): r for r in W.BundleReader(manifest[0]["path"])}
    assert {i: r.uri for i, r in found.items()} == {i: u or found[i].record_id for i, u in enumerate(urls)}
    assert {r["page_id"]: r["refers_to"] for r in W.read_bundles(spark, manifest).collect()} == {0: 1, 1: None, 2: 3, 3: None, 4: 5, 5: None}


def test_many_rows_without_an_id(spark, tmp_path):
    table = [(None, None, f"text {i % 50}", None, None, 1) for i in range(200)]
    got = W.read_bundles(spark, W.write_bundles(spark.createDataFrame(table, SCHEMA), f"file://{tmp_path}", bundles=3)).collect()
    assert len(got) == 200 and sum(r["record_type"] == "response" for r in got) == 50 and {r["refers_to"] for r in got} == {None}
