"""Pages of public web services: JSON over HTTP with retries, followed page by page and written for ``files.activities`` and ``files.compounds``."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Answers that may be better next time (fixed values).
AGAIN = (429, 500, 502, 503, 504)


class FetchError(RuntimeError):
    """A service gave no usable answer."""


def fetch_json(url: str, parameters: dict[str, object] | None = None, timeout: float = 30.0, tries: int = 3, wait: float = 1.0) -> dict:
    """The object at ``url``. Failures that may pass are tried again, after ``wait`` seconds and twice as long each time."""
    query = urllib.parse.urlencode({k: v for k, v in (parameters or {}).items() if v is not None})
    request = urllib.request.Request(url + ("&" if "?" in url else "?") * bool(query) + query, headers={"Accept": "application/json"})
    for turn in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code not in AGAIN or turn == tries - 1:
                raise FetchError(f"{url}: status {e.code}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            if turn == tries - 1:
                raise FetchError(f"{url}: {e}") from e
        except ValueError as e:
            raise FetchError(f"{url}: no JSON") from e
        time.sleep(wait * 2**turn)
    raise FetchError(url)


def pages(url: str, parameters: dict[str, object] | None = None, key: str = "activities", size: int = 1000, most: int | None = None, fetch: Callable[..., dict] = fetch_json) -> Iterator[dict]:
    """The pages of a listing that names its next page in page_meta, up to ``most`` records."""
    seen, given = 0, dict(parameters or {}) | {"limit": size, "offset": 0}
    at: str | None = url
    while at is not None and (most is None or seen < most):
        page = fetch(at, given)
        if not page.get(key):
            return
        yield page
        seen += len(page[key])
        following = (page.get("page_meta") or {}).get("next")
        at, given = (urllib.parse.urljoin(url, following), {}) if following else (None, {})


def capture(spark: SparkSession, url: str, path: str, parameters: dict[str, object] | None = None, key: str = "activities", size: int = 1000, most: int | None = None) -> DataFrame:
    """Write the pages of a listing into ``path``, a JSON file a page, and return their text (column value).

    A service is asked by one client, page after page, as its terms ask for; the pages written are the table to work on.
    """
    rows = ((json.dumps(p),) for p in pages(url, parameters, key, size, most))
    first = True
    for row in rows:
        spark.createDataFrame([row], "value string").coalesce(1).write.mode("overwrite" if first else "append").text(path)
        first = False
    if first:
        spark.createDataFrame([], "value string").write.mode("overwrite").text(path)
    return spark.read.schema("value string").text(path)
