import json
import logging
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest

from alembiq import logs
from alembiq.operators import conformers as Y
from alembiq.sources import files, remote


class Service(BaseHTTPRequestHandler):
    failures = 0

    def do_GET(self):
        at = urlparse(self.path)
        q = {k: int(v[0]) for k, v in parse_qs(at.query).items()}
        if at.path == "/gone" or Service.failures > 0:
            Service.failures -= 1
            self.send_response(404 if at.path == "/gone" else 503)
            self.end_headers()
            return
        offset, n = q.get("offset", 0), 5
        some = [{"molecule_chembl_id": f"M{i}", "canonical_smiles": "C" * (i + 1), "standard_value": str(i)} for i in range(offset, min(12, offset + n))]
        following = f"/data?limit={n}&offset={offset + n}" if offset + n < 12 else None
        body = b"text" if at.path == "/text" else json.dumps({"activities": some, "page_meta": {"next": following}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_pages_and_retries(spark, tmp_path, url):
    Service.failures = 2
    assert len(remote.fetch_json(f"{url}/data", {"limit": 5}, wait=0.01)["activities"]) == 5
    assert [len(p["activities"]) for p in remote.pages(f"{url}/data", size=5)] == [5, 5, 2]
    assert sum(len(p["activities"]) for p in remote.pages(f"{url}/data", size=5, most=6)) == 10
    Service.failures = 0
    for bad in ("/gone", "/text"):
        with pytest.raises(remote.FetchError):
            remote.fetch_json(url + bad, wait=0.01)
    remote.capture(spark, f"{url}/data", f"file://{tmp_path}/pages", size=5)
    rows = files.activities(spark, f"file://{tmp_path}/pages").collect()
    assert sorted(r["standard_number"] for r in rows) == list(range(12)) and {len(r["smiles"]) for r in rows} == set(range(1, 13))


def test_logs(tmp_path):
    log = logs.setup("info", str(tmp_path / "log"))
    assert list(logs.progress(range(25), "rows")) == list(range(25)) and list(logs.progress(iter("ab"))) == ["a", "b"]
    logs.logger("x").info("said")
    assert "said" in (tmp_path / "log").read_text() and "rows 20 of 25" in (tmp_path / "log").read_text()
    assert len(logs.setup("warning").handlers) == 1 and log.level == logging.WARNING
    assert logs.installed("json", "no_such_library") == {"json": True, "no_such_library": False} and logs.version()


def test_volume(spark):
    r = Y.RADII["C"]
    one = Y.volume_of(np.zeros((1, 3)), ["C"], 0.05)
    assert one == pytest.approx(4 / 3 * np.pi * r**3, rel=0.01)
    assert Y.volume_of(np.array([[0, 0, 0], [0, 0, 10.0]]), ["C", "C"], 0.1) == pytest.approx(2 * one, rel=0.02)
    assert one < Y.volume_of(np.array([[0, 0, 0], [0, 0, 1.5]]), ["C", "X"], 0.1) < 2 * one
    df = spark.createDataFrame([([(0.0, 0.0, 0.0)], ["O"]), (None, ["O"]), ([], [])], "coords array<struct<x:double,y:double,z:double>>, elements array<string>")
    got = [x["volume"] for x in Y.with_volume(df).collect()]
    assert got[0] == pytest.approx(4 / 3 * np.pi * Y.RADII["O"] ** 3, rel=0.03) and got[1] is None or got[1] != got[1]
    assert got[2] == 0.0
