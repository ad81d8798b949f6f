"""The engine's functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import dom
from pagewright.sources.feeds import entries

_LINKS = "array<struct<href: string, text: string, rel: string, is_internal: boolean>>"
_BLOCKS = "array<struct<type: string, level: int, text: string, url: string, alt: string, caption: string, language: string, ordered: boolean, items: array<string>, rows: array<array<string>>>>"


class Feed:
    """Rows of a feed: ``url, title, author, published_at, summary``."""

    def eval(self, xml: str, base: str) -> Iterator[tuple]:
        for e in entries(xml, base or ""):
            yield tuple(e[k] for k in ("url", "title", "author", "published_at", "summary"))


def _of_page(part: str, field: str, kind: str):  # noqa: ANN202
    @F.pandas_udf(kind)
    def read(html: pd.Series, url: pd.Series) -> pd.Series:
        return pd.Series([dom.article(h, u, frozenset((part,)))[field] for h, u in zip(html, url, strict=True)])

    return read


def register(spark: SparkSession) -> list[str]:
    """Registers the functions with a session; their names.

    ``html_links``, ``html_blocks``, ``html_markdown``, ``html_text`` and
    ``html_score`` take (html, url); ``parse_feed(xml, base)`` is a table
    function; ``reading_minutes(words)``, ``content_digest(text)`` and
    ``raw_words(html)`` are plain SQL. Null HTML is an empty page.
    """
    for name, part, field, kind in (
        ("html_links", "links", "links", _LINKS), ("html_blocks", "blocks", "content_blocks", _BLOCKS), ("html_markdown", "markdown", "content_markdown", "string"),
        ("html_text", "text", "content_text", "string"), ("html_score", "score", "content_score", "int"),
    ):
        spark.udf.register(name, _of_page(part, field, kind))
    fields = [T.StructField(n, T.StringType()) for n in ("url", "title", "author", "published_at", "summary")]
    spark.udtf.register("parse_feed", F.udtf(Feed, returnType=T.StructType(fields)))
    for name, head, body in (
        ("reading_minutes", "words bigint) returns int", "cast(greatest(1, ceil(words / 200)) as int)"),
        ("content_digest", "text string) returns string", r"substr(sha2(substr(regexp_replace(text, '(?U)^\\s+|\\s+$', ''), 1, 5000), 256), 1, 16)"),
        ("raw_words", "html string) returns int", r"coalesce(size(filter(split(regexp_replace(html, '<[^>]+>', ' '), '(?U)\\s+'), w -> w <> '')), 0)"),
    ):
        spark.sql(f"create or replace temporary function {name}({head} return {body}")
    return ["html_links", "html_blocks", "html_markdown", "html_text", "html_score", "parse_feed", "reading_minutes", "content_digest", "raw_words"]
