"""WARC archives in seekable Zstandard bundles.

Every page becomes a WARC record. Pages with equal payloads are stored once, as the response of the
largest page_id; the others are revisit records that refer to it. Records are grouped into
independent Zstandard frames; an index after them maps each record's identifier to its frame and to
its offset and length in the frame, and the seek table at the end maps frames to file offsets, so one
record is read by decompressing one frame.

Payloads are compared by SHA-1 and length. Holders of a payload are found by an aggregation, and
meet their pages in a join in which payloads held by more than one in HOT of all pages are broadcast
(there are at most HOT of them), so a payload that fills a third of the table is dealt out. Pages
and what is known of their payloads' holders are then dealt out by page_id and payload together, so payloads are
shuffled once, and each task writes the bundle of its part.

Defined results: null and empty payloads are payloads of 0 bytes, equal to each other; of rows that
repeat a page_id and payload the first is the response if that page_id holds it, and the others
revisit it; a null page_id is less than all others and can be a response only among its like; a null
url is written as the record's own identifier; control characters of a url are percent-encoded in the
target URI and kept in a header of its own; an empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import seekable
from .common import partitions, released, table, text_batches, work_path, written

#: Bytes of records a frame holds at least, unless the bundle ends.
FRAME_BYTES = 1 << 20
HOT = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The date of records whose capture time is unknown.
EPOCH = "1970-01-01T00:00:00Z"
_PAGE = "urn:alembiq:page:"
#: The header that keeps a URL that is no URI, as a JSON string.
ORIGINAL = "Source-URL"
_UNSAFE = re.compile(r"[\x00-\x20\x7f-\xa0\u2028\u2029\ud800-\udfff]")
#: Bytes of payloads a bundle holds on average, at most; rows that leave a reader at once.
BUNDLE_BYTES, READ_ROWS = 1 << 26, 1 << 14


def header_uri(url: str) -> str:
    """``url`` as a header can hold it."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    """One record. The target URI is written with control and white-space characters percent-encoded, and a URL that this changes is kept beside it."""

    record_id: str
    kind: str
    uri: str
    digest: str
    payload_bytes: int
    payload: bytes | None
    refers_to: str | None = None

    def to_bytes(self, date: str = EPOCH) -> bytes:
        """A response with its payload, or a revisit with the HTTP headers alone."""
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {self.payload_bytes}\r\n\r\n".encode()
        body = http + (self.payload or b"" if self.kind == "response" else b"")
        target = header_uri(self.uri)
        head = [("WARC-Type", self.kind), ("WARC-Record-ID", f"<{self.record_id}>"), ("WARC-Target-URI", target), *([(ORIGINAL, json.dumps(self.uri))] if target != self.uri else []), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{self.digest}")]
        if self.kind == "revisit":
            head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{self.refers_to}>")]
        head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
        return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"

    @classmethod
    def parse(cls, data: bytes, at: int = 0) -> tuple[Record, int]:
        """The record at an offset, and the offset after it."""
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no WARC record at {at}")
        head = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(head["Content-Length"])
        split = data.index(b"\r\n\r\n", start)
        http = dict(x.split(": ", 1) for x in data[start:split].decode().split("\r\n")[1:])
        kind = head["WARC-Type"]
        payload = data[split + 4 : stop] if kind == "response" else None
        refers = head.get("WARC-Refers-To", "").strip("<>") or None
        uri = json.loads(head[ORIGINAL]) if ORIGINAL in head else head["WARC-Target-URI"]
        return cls(head["WARC-Record-ID"].strip("<>"), kind, uri, head["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"]), payload, refers), stop + 4


def page_urn(page_id: int | None, digest: str, turn: int = 0) -> str:
    """The record identifier of a page and payload; rows that repeat both are told apart by their turn."""
    return f"{_PAGE}{'null' if page_id is None else page_id}:{digest}" + (f":{turn}" if turn else "")


def page_of(urn: str | None) -> int | None:
    name = (urn or f"{_PAGE}null").removeprefix(_PAGE).split(":")[0]
    return None if name == "null" else int(name)


class BundleWriter:
    def __init__(self, uri: str):
        self.out = seekable.Writer(uri)
        self.held, self.size = [], 0
        self.index: list[tuple[str, int, int, int]] = []

    def add(self, record: Record) -> None:
        data = record.to_bytes()
        self.index.append((record.record_id, len(self.out.entries), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.out.frame(b"".join(self.held))
            self.held, self.size = [], 0

    def close(self) -> int:
        self._flush()
        self.out.close(json.dumps(self.index).encode())
        return len(self.index)


class BundleReader:
    def __init__(self, uri: str):
        self.file = seekable.Reader(uri)
        self.index = [tuple(x) for x in json.loads(self.file.index())]
        self.by_id = {x[0]: x for x in self.index}

    def get(self, record_id: str) -> Record:
        """One record, by its identifier; decompresses its frame only."""
        _, frame, offset, _ = self.by_id[record_id]
        return Record.parse(self.file.frame(frame), offset)[0]

    def __iter__(self) -> Iterator[Record]:
        for frame in range(len(self.file.entries) - 1):
            data, at = self.file.frame(frame), 0
            while at < len(data):
                record, at = Record.parse(data, at)
                yield record


def with_holders(pages: DataFrame) -> DataFrame:
    """page_id, digest, holder: for each page whose payload several rows hold, the page_id of its response."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    prints = written(pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("bytes")), "warc-digests")
    shared = written(prints.groupBy("digest", "bytes").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1"), "warc-shared")
    least = max(1, prints.count() // HOT)
    hot, cold = shared.where(F.col("n") > least), shared.where(F.col("n") <= least)
    keys = ["digest", "bytes"]
    found = prints.join(F.broadcast(hot), keys).unionByName(prints.join(cold, keys))
    return found.select("page_id", "digest", "holder").distinct()


def write_bundles(pages: DataFrame, folder: str, bundles: int | None = None, least_bytes: int = 0) -> list[dict]:
    """Write ``pages`` (page_id, url, html) as bundles into ``folder``; returns a manifest, one entry a bundle.

    Payloads of fewer than ``least_bytes`` bytes are responses always.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("page_id", F.sha1("payload").alias("digest"), F.lit(True).alias("is_page"), F.lit(None).cast("long").alias("holder"), "url", "payload")
    told = with_holders(pages).select("page_id", "digest", F.lit(False).alias("is_page"), "holder", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by page_id and digest; what is told of the holder of a payload comes before its pages."""
        uri = f"{folder}/bundle-{TaskContext.get().partitionId():06d}.warc.zst"
        out, at, turn, holder = None, None, 0, None
        try:
            for b in batches:
                pages_, digests, kinds, holders = (b.column(c).to_pylist() for c in ("page_id", "digest", "is_page", "holder"))
                for i, (page, key, is_page) in enumerate(zip(pages_, digests, kinds)):
                    if at != (page, key):
                        at, turn, holder = (page, key), 0, None
                    if not is_page:
                        holder = (holders[i],)
                        continue
                    out = out or BundleWriter(uri)
                    url, payload = b.column("url")[i].as_py(), b.column("payload")[i].as_py()
                    revisit = holder is not None and len(payload) >= least_bytes and (holder[0] != page or turn > 0)
                    digest = base32_sha1(payload)
                    own = page_urn(page, digest, turn)
                    out.add(Record(own, "revisit" if revisit else "response", url or own, digest, len(payload), payload, page_urn(holder[0], digest) if revisit else None))
                    turn += 1
        except BaseException:
            if out:
                out.out.abandon()
            raise
        if out:
            yield pa.RecordBatch.from_pydict({"path": [uri], "n": [out.close()]})

    text_batches(pages.sparkSession)
    if bundles is None:
        size = rows.agg(F.sum(F.octet_length("payload").cast("long"))).first()[0] or 0
        bundles = max(partitions(pages.sparkSession), -(-size // BUNDLE_BYTES))
    keys = ["page_id", "digest"]
    dealt = rows.unionByName(told).repartition(bundles, *keys).sortWithinPartitions(*keys, "is_page")
    return [r.asDict() for r in dealt.mapInArrow(released(write), "path string, n long").collect()]  # one row a bundle


def read_bundles(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from the files. Payloads that are stored are hashed again."""

    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def rows(uri: str) -> Iterator[tuple]:
        for r in BundleReader(uri):
            if r.payload is not None and (len(r.payload) != r.payload_bytes or base32_sha1(r.payload) != r.digest):
                raise ValueError(f"{uri}: the payload of {r.record_id} is damaged")
            yield page_of(r.record_id), r.payload_bytes, r.digest, r.kind, page_of(r.refers_to) if r.refers_to else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column("path").to_pylist():
                found = rows(uri)
                while part := list(islice(found, READ_ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    files = spark.createDataFrame([(m["path"],) for m in manifest], "path string")
    return files.repartition(max(1, len(manifest))).mapInArrow(released(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, f"warc-{uuid.uuid4().hex[:8]}")
    return read_bundles(spark, write_bundles(table(spark, sf_dir, "pages"), folder))


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), g AS (
  SELECT page_id, html, h, max(page_id) OVER (PARTITION BY html) AS holder FROM p
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(h, i // 4 * 5 + 1, 5) AS INTEGER) >> (15 - i % 4 * 5)) & 31) AS INTEGER) + 1, 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM g
"""
