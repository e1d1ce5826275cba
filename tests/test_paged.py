"""The paged data source against a local service: in parallel, with filters, failures and restarts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from alembiq.sources.paged import PagedListing

SCHEMA = "molecule_chembl_id string, standard_value double, n long"


class Service(BaseHTTPRequestHandler):
    records, asked, failing = [], [], set()

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Service.asked.append(q)
        offset, limit = int(q["offset"]), int(q["limit"])
        if offset in Service.failing:
            Service.failing.discard(offset)
            self.send_response(503)
            self.end_headers()
            return
        rows = Service.records
        if "n__gte" in q:
            rows = [r for r in rows if r["n"] is not None and r["n"] >= int(q["n__gte"])]
        if "molecule_chembl_id" in q:
            rows = [r for r in rows if r["molecule_chembl_id"] == q["molecule_chembl_id"]]
        only = set(q["only"].split(","))
        page = [{k: v for k, v in r.items() if k in only} for r in rows[offset : offset + min(limit, 7)]]
        body = json.dumps({"activities": page, "page_meta": {"total_count": len(rows)}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def url(spark):
    Service.records = [{"molecule_chembl_id": f"M{i % 40}", "standard_value": f"{i}.5" if i % 10 else "n/a", "n": i, "more": "x"} for i in range(100)]
    Service.asked, Service.failing = [], set()
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedListing)
    yield f"http://127.0.0.1:{server.server_port}/data"
    server.shutdown()


def read(spark, url, **options):
    r = spark.read.format("paged_listing").schema(SCHEMA).option("url", url).option("size", 10).option("pages", 2).option("wait", 0.01)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def test_pages_are_read_in_parallel(spark, url):
    Service.failing = {20, 47}
    df = read(spark, url)
    assert df.rdd.getNumPartitions() == 5
    rows = sorted(df.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(100))
    assert [r["standard_value"] for r in rows[:2]] == [None, 1.5] and rows[41]["molecule_chembl_id"] == "M1"
    assert {q["only"] for q in Service.asked} == {"molecule_chembl_id,standard_value,n"}


def test_filters_go_to_the_service(spark, url):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = read(spark, url, filters="n,molecule_chembl_id").where((F.col("n") >= 50) & (F.col("molecule_chembl_id") == "M20") & (F.col("standard_value") > 1))
        assert [r["n"] for r in got.collect()] == []
        got = read(spark, url, filters="n").where((F.col("n") >= 90) & (F.col("molecule_chembl_id") != "M15")).collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    assert sorted(r["n"] for r in got) == [n for n in range(90, 100) if n != 95]
    assert {q.get("n__gte") for q in Service.asked} == {"50", "90"} and any(q.get("molecule_chembl_id") == "M20" for q in Service.asked)


def test_a_listing_of_nothing_and_one_without_length(spark, url):
    Service.records = []
    assert read(spark, url).collect() == []
    with pytest.raises(Exception, match="schema"):
        spark.read.format("paged_listing").option("url", url).load()


def test_a_stream_goes_on_where_it_ended(spark, url, tmp_path):
    def run():
        rows = spark.readStream.format("paged_listing").schema(SCHEMA).option("url", url).option("size", 10).option("pages", 1).option("wait", 0.01).load()
        query = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == list(range(100))
    Service.records = [*Service.records, *({"molecule_chembl_id": "new", "standard_value": "1", "n": n} for n in range(100, 131))]
    Service.asked = []
    assert run() == list(range(131))
    assert all(int(q["offset"]) >= 100 or q["limit"] == "1" for q in Service.asked)
    assert run() == list(range(131))
