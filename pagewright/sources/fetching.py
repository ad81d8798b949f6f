"""Fetching pages: a transport that can be put in, and its rules as plain functions.

On a cluster a transport runs inside one Arrow stage over a table of addresses,
spread by host so that no host is asked by more than a few tasks at once. Where
responses are already in a table, ``operators.fetching`` joins them instead.
"""

from __future__ import annotations

import gzip
import random
import time
import zlib
from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls

#: Answers after which a server is asked again.
AGAIN = frozenset((429, 500, 502, 503, 504))
AGENT = "Mozilla/5.0 (compatible; pagewright)"


class FetchError(Exception):
    """A page that couldn't be had; ``status`` is 0 where there was no answer."""

    def __init__(self, url: str, reason: str, status: int = 0) -> None:
        super().__init__(f"{reason}: {url}")
        self.url, self.reason, self.status = url, reason, status


def retry_delay(attempt: int, retry_after: str | None = None, jitter: float = 0.0) -> float:
    """Seconds before another try: doubled each time, or what the server asks for if that is longer."""
    wait = 2.0**attempt
    if retry_after and retry_after.strip().isdigit():
        wait = max(wait, float(retry_after))
    return wait + jitter


def decoded(body: bytes, encoding: str | None = None, content_type: str | None = None) -> str:
    """A response's text: unpacked, in its charset (UTF-8 if unnamed or unknown), what is broken replaced."""
    kind = (encoding or "").strip().lower()
    if kind == "gzip":
        body = gzip.decompress(body)
    elif kind == "deflate":
        try:
            body = zlib.decompress(body)
        except zlib.error:
            body = zlib.decompress(body, -zlib.MAX_WBITS)
    elif kind == "br":
        raise ValueError("brotli isn't supported")
    _, _, charset = (content_type or "").lower().partition("charset=")
    try:
        return body.decode(charset.split(";")[0].strip("\"' ") or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def http(url: str, timeout: float = 30, agent: str | None = None, tries: int = 3, opened: Callable = urlopen, sleep: Callable[[float], None] = time.sleep) -> str:
    """The page at an address over HTTP; ``FetchError`` if it can't be had. ``opened`` and ``sleep`` are for tests."""
    if urlsplit(url).scheme not in ("http", "https"):
        raise FetchError(url, "only http and https can be fetched")
    headers = {"User-Agent": agent or AGENT, "Accept": "text/html,application/xhtml+xml,*/*;q=0.8", "Accept-Encoding": "gzip, deflate", "Accept-Language": "en;q=0.9,*;q=0.5"}
    for attempt in range(tries + 1):
        after, status, reason = None, 0, ""
        try:
            with opened(Request(url, headers=headers), timeout=timeout) as answer:
                return decoded(answer.read(), answer.headers.get("Content-Encoding"), answer.headers.get("Content-Type"))
        except HTTPError as e:
            after, status, reason = e.headers.get("Retry-After") if e.headers else None, e.code, f"http status {e.code}"
            if status not in AGAIN:
                raise FetchError(url, reason, status) from e
        except OSError as e:
            reason = str(e) or type(e).__name__
        except (ValueError, EOFError, zlib.error) as e:
            raise FetchError(url, str(e)) from e
        if attempt < tries:
            sleep(retry_delay(attempt, after, random.random()))
    raise FetchError(url, reason, status)


def fetch_pages(addresses: DataFrame, transport: Callable[[str], str] = http, tasks: int = 8) -> DataFrame:
    """The rows of ``addresses`` (with ``url``) and ``html, status, error`` of each; errors are rows like others.

    ``tasks`` bounds how many are asked for at once; one host's addresses are
    asked for by one task. A null address is an error of its own.
    """
    names = [c for c in addresses.columns if c not in ("html", "status", "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url in batch.column("url").to_pylist():
                try:
                    if url is None:
                        raise FetchError("", "no address")
                    out.append((transport(url), 200, None))
                except FetchError as e:
                    out.append((None, e.status, e.reason))
                except Exception as e:  # whatever a transport raises is this page's error, not the job's
                    out.append((None, 0, f"{type(e).__name__}: {e}"))
            html, status, error = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(html, pa.string()), pa.array(status, pa.int32()), pa.array(error, pa.string())], [*names, "html", "status", "error"])

    schema = ", ".join(f"`{c}` {addresses.schema[c].dataType.simpleString()}" for c in names)
    return addresses.select(names).repartition(tasks, urls.domain(F.col("url"))).mapInArrow(run, f"{schema}, html string, status int, error string")
