"""Pages to articles: one Arrow stage reads the HTML, all else is expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.functions import dom, texts, urls

FACTS = """title string, author string, published_at string, updated_at string, site_name string, summary string, language string, tags array<string>, canonical_url string,
body_word_count int, is_js_spa boolean, is_cookie_walled boolean, is_paywalled boolean, js_root_found boolean, frameworks_detected array<string>, needs_js boolean, has_meta_title boolean, has_article_schema boolean,
amp_url string, next_url string, feed_url string, content_score int, content_markdown string, content_text string,
content_blocks array<struct<type: string, level: int, text: string, url: string, alt: string, caption: string, language: string, ordered: boolean, items: array<string>, rows: array<array<string>>>>,
images array<struct<url: string, alt: string, caption: string>>, links array<struct<href: string, text: string, rel: string, is_internal: boolean>>, word_count int, extraction_method_used string"""
#: Pages that a worker turns into Arrow rows at once.
ROWS = 64


def facts(pages: DataFrame, *parts: str) -> DataFrame:
    """The columns of ``pages`` but ``html`` and names that clash, and all of ``FACTS``, or those of the named ``dom.PARTS`` with nulls for the rest.

    Null HTML is an empty page.
    """
    found = StructType.fromDDL(FACTS)
    kept = [c for c in pages.columns if c.lower() != "html" and c.lower() not in found.fieldNames()]
    html, url = (free(x, pages.columns) for x in ("_html", "_url"))
    arrow, wanted = to_arrow_schema(found), frozenset(parts) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [dom.article(h, u, wanted) for h, u in zip(part.column(html).to_pylist(), part.column(url).to_pylist(), strict=True)]
                read = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *read.columns], [*kept, *read.schema.names])

    out = StructType([pages.schema[c] for c in kept] + found.fields)
    return pages.select(*kept, F.col("html").alias(html), F.col("url").alias(url)).mapInArrow(run, out)


def classification() -> Column:
    """``page_type, strategy, confidence``: the first rule that holds."""
    words, spa = F.col("body_word_count"), F.size("frameworks_detected") > 0
    rule = lambda kind, how, sure: F.struct(F.lit(kind).alias("page_type"), (how if isinstance(how, Column) else F.lit(how)).alias("strategy"), (sure if isinstance(sure, Column) else F.lit(sure)).alias("confidence"))
    amp = F.col("amp_url").isNotNull()
    return (
        F.when(F.col("is_js_spa"), rule("js_spa", F.when(amp, "amp").otherwise("playwright"), F.when(spa, 0.9).otherwise(0.8)))
        .when(F.col("is_cookie_walled"), rule("cookie_walled", "playwright", 0.85))
        .when(F.col("is_paywalled") & (words < 500), rule("paywalled", "playwright", 0.75))
        .when(amp & (words < 150), rule("static_html", "amp", 0.7))
        .when(words >= 150, rule("static_html", "static", 0.9))
        .when(F.col("has_meta_title"), rule("unknown", "mobile_ua", 0.5))
        .otherwise(rule("static_html", "static", 0.55))
    )


#: What ``extract`` adds to the facts.
ADDED = "page_type strategy confidence reading_time_minutes article_score norm_url slug markdown_document".split()


def extract(pages: DataFrame) -> DataFrame:
    """Articles of ``pages`` (url, html and any other columns), one a row, with the page's class and score.

    A null or empty page gives empty text, no blocks and the dom_heuristic
    method; repeated pages come out repeated. A column of ``pages`` that is
    called like one of the results is replaced by it.
    """
    rows = pages.drop(*[c for c in pages.columns if c.lower() in ADDED])
    kind = free("_class", rows.columns)
    read = facts(rows).withColumn(kind, classification())
    return read.select(
        "*", f"{kind}.*", texts.reading_time(F.col("word_count")).alias("reading_time_minutes"), (urls.url_score(F.col("url")) + F.col("content_score")).alias("article_score"),
        urls.normalize_url(F.col("url")).alias("norm_url"), urls.slug(F.col("url")).alias("slug"),
        texts.markdown_document(F.col("title"), F.col("author"), F.col("published_at"), F.col("tags"), F.col("summary"), F.col("content_markdown")).alias("markdown_document"),
    ).drop(kind)


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores until no column is called so."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def accepted(articles: DataFrame, least: int = 35, include: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Articles with the score, and ``url, reason`` of the others."""
    fits = F.col("url").rlike(include) if include else F.lit(True)
    reason = F.when(~fits, "include_regex_mismatch").when(F.col("article_score") < least, F.concat(F.lit("low_article_score ("), "article_score", F.lit(")")))
    marked = articles.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").selectExpr("url", "_reason as reason")
