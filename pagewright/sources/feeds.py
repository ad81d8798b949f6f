"""RSS, Atom and sitemap documents as rows."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

_DC = "{http://purl.org/dc/elements/1.1/}"
_SITEMAP = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def _said(e: ElementTree.Element | None) -> str | None:
    """What an element says, or null."""
    words = "" if e is None or e.text is None else e.text.strip()
    return words or None


def _root(xml: str | None) -> ElementTree.Element | None:
    try:
        return ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return None


def entries(xml: str | None, base: str = "") -> list[dict]:
    """url, title, author, published_at, summary of each entry that has an address; broken XML has none."""
    root = _root(xml)
    if root is None:
        return []
    out = []
    for item in root.iter("item"):
        guid = item.find("guid")
        mark = _said(guid) if guid is not None and guid.get("isPermaLink", "true").lower() != "false" else None
        url = _said(item.find("link")) or mark
        if url:
            out.append({"url": url, "title": _said(item.find("title")), "author": _said(item.find(f"{_DC}creator")) or _said(item.find("author")), "published_at": _said(item.find("pubDate")) or _said(item.find(f"{_DC}date")), "summary": _said(item.find("description"))})
    if out:
        return out
    for entry in root.iter():
        if entry.tag.rpartition("}")[2] != "entry":
            continue
        kids: dict[str, list[ElementTree.Element]] = {}
        for k in entry:
            kids.setdefault(k.tag.rpartition("}")[2], []).append(k)
        one = lambda name: _said(kids[name][0]) if name in kids else None  # noqa: E731, B023
        href = next((k.get("href") for k in kids.get("link", []) if k.get("rel", "alternate") in ("alternate", "") and k.get("href")), None)
        author = next((_said(k) for a in kids.get("author", []) for k in a if k.tag.rpartition("}")[2] == "name"), None)
        if href:
            out.append({"url": urljoin(base, href), "title": one("title"), "author": author, "published_at": one("published") or one("updated"), "summary": one("summary") or one("content")})
    return out


def locations(xml: str | None) -> list[dict]:
    """url and kind (``sitemap`` or ``page``) of each place that a sitemap names."""
    root = _root(xml)
    if root is None:
        return []
    kind = "sitemap" if root.tag.endswith("sitemapindex") else "page"
    return [{"url": u, "kind": kind} for e in root.iter(f"{_SITEMAP}loc") if (u := _said(e))]


def read_feeds(feeds: DataFrame, most: int | None = None) -> DataFrame:
    """The entries of each row (feed_url, xml), or the first ``most``, with their place ``pos``."""
    names = ["url", "title", "author", "published_at", "summary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feed_url", pa.string()), ("pos", pa.int32()), *[(n, pa.string()) for n in names]])
        for batch in batches:
            rows = [{"feed_url": u, "pos": i, **e} for u, x in zip(batch.column("feed_url").to_pylist(), batch.column("xml").to_pylist(), strict=True) for i, e in enumerate(entries(x, u or "")[:most])]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return feeds.select("feed_url", "xml").mapInArrow(run, "feed_url string, pos int, " + ", ".join(f"{n} string" for n in names))


def read_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """``sitemap_url, url, kind`` of every place named by rows (sitemap_url, xml)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("sitemap_url", pa.string()), ("url", pa.string()), ("kind", pa.string())])
        for batch in batches:
            rows = [{"sitemap_url": u, **e} for u, x in zip(batch.column("sitemap_url").to_pylist(), batch.column("xml").to_pylist(), strict=True) for e in locations(x)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return sitemaps.select("sitemap_url", "xml").mapInArrow(run, "sitemap_url string, url string, kind string")
