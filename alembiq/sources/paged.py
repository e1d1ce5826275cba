"""Listings of web services as a Spark data source: pages are read in parallel by offset, in batches or as a stream.

    spark.dataSource.register(PagedListing)
    spark.read.format("paged_listing").schema("molecule_chembl_id string, standard_value string").option("url", url).load()

A listing answers ``limit`` and ``offset``, and gives its length as page_meta.total_count. The driver asks for the length alone; each
task reads a range of offsets, page by page, with retries. The schema given is what is asked for (``only``) and kept; values become its
types, null where they are none. Comparisons of its fields with constants are sent to the service as
field, field__gt, field__gte, field__lt, field__lte, field__in and field__isnull, where the option ``filters`` names the field (the
session must then have spark.sql.python.filterPushdown.enabled).

As a stream, a listing to whose end records are added is read up to its length at each trigger. Offsets are in the query's
checkpoint, so a restart goes on where the last committed batch ended; a batch that is run again reads the same offsets.

Options: url; key (the listing's name, activities); size (records of a page, 1000); pages (of a task, 10); filters (names, by commas); parameters (a
JSON object of further parameters); tries and wait (of ``remote.fetch_json``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from .remote import FetchError, fetch_json

SUFFIXES = {EqualTo: "", GreaterThan: "__gt", GreaterThanOrEqual: "__gte", LessThan: "__lt", LessThanOrEqual: "__lte"}


@dataclass
class Offsets(InputPartition):
    start: int
    end: int


class _Listing:
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.schema, self.url, self.key = schema, options["url"], options.get("key", "activities")
        self.size, self.pages = int(options.get("size", 1000)), int(options.get("pages", 10))
        self.tries, self.wait = int(options.get("tries", 3)), float(options.get("wait", 1.0))
        self.filters = {f.strip() for f in options.get("filters", "").split(",") if f.strip()}
        self.parameters = json.loads(options.get("parameters", "{}")) | {"only": ",".join(schema.fieldNames())}

    def ask(self, offset: int, limit: int) -> dict:
        return fetch_json(self.url, self.parameters | {"offset": offset, "limit": limit}, tries=self.tries, wait=self.wait)

    def length(self) -> int:
        found = (self.ask(0, 1).get("page_meta") or {}).get("total_count")
        if not isinstance(found, int):
            raise FetchError(f"{self.url}: no page_meta.total_count")
        return found

    def ranges(self, start: int, end: int) -> list[Offsets]:
        step = self.size * self.pages
        return [Offsets(at, min(end, at + step)) for at in range(start, end, step)] or [Offsets(start, start)]

    def rows(self, part: Offsets) -> Iterator[tuple]:
        """The records of a range; a page may hold fewer than were asked for, an empty one ends the range."""
        at = part.start
        while at < part.end:
            page = self.ask(at, min(self.size, part.end - at)).get(self.key) or []
            if not page:
                return
            for record in page[: part.end - at]:
                yield tuple(_typed(record.get(f.name), f.dataType) for f in self.schema.fields)
            at += len(page)


def _typed(v: object, kind: T.DataType) -> object:
    """``v`` as a value of the type; null where it is none."""
    if v is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return v if isinstance(v, str) else json.dumps(v)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(v)
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return int(v)
        if isinstance(kind, T.BooleanType):
            return {"true": True, "false": False, "1": True, "0": False}.get(str(v).lower())
    except (TypeError, ValueError):
        return None
    raise TypeError(f"{kind.simpleString()} columns are not supported")


class _Reader(DataSourceReader):
    def __init__(self, listing: _Listing):
        self.listing = listing

    def partitions(self) -> list[Offsets]:
        return self.listing.ranges(0, self.listing.length())

    def read(self, partition: Offsets) -> Iterator[tuple]:
        return self.listing.rows(partition)


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Send what the service can decide; the rest stays with Spark."""
        sent = self.listing.parameters
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name not in self.listing.filters:
                yield f
            elif type(f) in SUFFIXES and isinstance(f.value, (str, int, float)) and name + SUFFIXES[type(f)] not in sent:
                sent[name + SUFFIXES[type(f)]] = f.value
            elif isinstance(f, In) and f.value and all(isinstance(v, (str, int)) and "," not in str(v) for v in f.value) and name + "__in" not in sent:
                sent[name + "__in"] = ",".join(map(str, f.value))
            elif isinstance(f, (IsNull, IsNotNull)) and name + "__isnull" not in sent:
                sent[name + "__isnull"] = str(isinstance(f, IsNull)).lower()
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    def __init__(self, listing: _Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        return {"offset": self.listing.length()}

    def partitions(self, start: dict, end: dict) -> list[Offsets]:
        return self.listing.ranges(start["offset"], end["offset"])

    def read(self, partition: Offsets) -> Iterator[tuple]:
        return self.listing.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing to release: the listing keeps its records."""


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        raise ValueError("paged_listing needs a schema: the fields to ask for")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        listing = _Listing(schema, dict(self.options))
        return _FilteringReader(listing) if listing.filters else _Reader(listing)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(_Listing(schema, dict(self.options)))
