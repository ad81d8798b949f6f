"""Fetched pages to articles over tables: guards, the adaptive chain, batches and feeds as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import texts, urls
from pagewright.operators import pages
from pagewright.plans.cut import cut
from pagewright.sources import feeds

#: Words of a page that is good as it is.
ENOUGH = 150
ON_ERROR = ("skip", "raise", "include")


def response_guard(status: str = "status", content_type: str = "content_type") -> Column:
    """Why a response is no page: its status, or a content type that isn't HTML; null if it is one."""
    kind = F.coalesce(F.col(content_type), F.lit(""))
    return F.when(~F.col(status).eqNullSafe(200), F.concat(F.lit("http_status_"), F.coalesce(F.col(status).cast("string"), F.lit("0")))).when((kind != "") & ~F.lower(kind).contains("html"), "not_html")


def adaptive(fetched: DataFrame, alternates: DataFrame) -> DataFrame:
    """``fetched`` (url, html) with the best version's ``html`` and ``strategy_used``, ``page_type``, ``strategy``, ``confidence``.

    ``alternates`` has ``url, kind, html`` of other versions of the same pages
    (amp, mobile, rendered). A version is taken if the page's class asks for it
    and it has more words than the page has; a page of too few words falls back
    to the rendered one. Of several versions of a kind the greatest text counts;
    rows of ``fetched`` come out once each, also with a null address.
    """
    kinds = ("amp", "mobile", "rendered")
    # one row an address, so that nothing is repeated by the join
    best = alternates.where("url is not null").groupBy(F.col("url").alias("_at")).agg(*[F.max(F.when(F.col("kind") == k, F.col("html"))).alias(f"_{k}") for k in kinds])
    read = pages.facts(fetched.withColumn("_page", F.col("html")), "signals")
    read = read.select(*[c for c in fetched.columns if c != "html"], "_page", "amp_url", F.col("body_word_count").alias("_words"), pages.classification().alias("_class"))
    words = lambda k: F.when(F.col(f"_{k}").isNotNull(), texts.raw_word_count(F.col(f"_{k}")))
    asked, own = F.col("_class.strategy"), F.col("_words")
    fallback = (asked != "playwright") & (own < ENOUGH) & (words("rendered") > own)
    used = (
        F.when((asked == "static") & (own >= ENOUGH), "static")
        .when((asked == "amp") & F.col("amp_url").isNotNull() & (words("amp") > own), "amp")
        .when((asked == "mobile_ua") & (words("mobile") > own * 1.3), "mobile_ua")
        .when((asked == "playwright") & (words("rendered") > own), "playwright")
        .when(fallback, "playwright_fallback")
        .otherwise("static_best_effort")
    )
    joined = read.join(best, F.col("url") == F.col("_at"), "left").withColumn("strategy_used", used)
    html = F.when(F.col("strategy_used") == "amp", F.col("_amp")).when(F.col("strategy_used") == "mobile_ua", F.col("_mobile")).when(F.col("strategy_used").startswith("playwright"), F.col("_rendered")).otherwise(F.col("_page"))
    return joined.select(*[c for c in fetched.columns if c != "html"], html.alias("html"), "strategy_used", "_class.*")


def fetch_batch(addresses: DataFrame, responses: DataFrame, on_error: str = "skip", alternates: DataFrame | None = None, own: bool = False) -> DataFrame:
    """Articles of ``addresses`` (idx, url), in the order of idx, from ``responses`` (url, status, content_type, html).

    What has no usable response is left out (``skip``), kept with nulls and its
    ``error`` (``include``), or fails the query when it is read (``raise``).
    Of several responses of one address the first usable one counts, by the
    greatest HTML. Repeated addresses give repeated articles; with ``own``,
    responses have idx too, and each counts for the row only that it was
    fetched for.
    """
    if on_error not in ON_ERROR:
        raise ValueError(f"on_error must be one of {', '.join(ON_ERROR)}; it is {on_error!r}")
    reason = response_guard()
    one = responses.where("url is not null").groupBy(F.col("url").alias("_of"), *[F.col("idx").alias("_for")] * own).agg(F.max(F.struct(reason.isNull().alias("good"), F.coalesce("html", F.lit("")).alias("html"), F.coalesce(reason, F.lit("")).alias("why"))).alias("_r"))
    scheme = F.lower(urls.part(F.col("url"), 1))
    error = F.when(~F.coalesce(scheme.isin("http", "https"), F.lit(False)), "only http and https can be fetched").when(F.col("_r").isNull(), "no response").when(~F.col("_r.good"), F.col("_r.why"))
    joined = addresses.select("idx", "url").join(one, (F.col("url") == F.col("_of")) & (F.col("idx") == F.col("_for") if own else F.lit(True)), "left").select("idx", "url", F.col("_r.html").alias("html"), error.alias("error"))
    if on_error == "skip":
        joined = joined.where("error is null")
    elif on_error == "raise":
        joined = joined.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(": ", "error", "url"))).cast("string"))
    if alternates is not None:
        joined = adaptive(joined, alternates).drop("page_type", "strategy", "confidence")
    read = pages.extract(joined)
    names = [c for c in read.columns if c not in joined.columns]
    return read.select(*[c for c in joined.columns if c != "html"], *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in names]).orderBy("idx")


def fetch_feed(feed_rows: DataFrame, responses: DataFrame, most: int | None = 50) -> DataFrame:
    """Articles of the first ``most`` entries of each feed (feed_url, xml), with ``feed_url, pos``; entries without a usable response are left out."""
    named = cut(feeds.read_feeds(feed_rows, most).select("feed_url", "pos", "url").withColumn("idx", F.struct("feed_url", "pos")))
    return fetch_batch(named.select("idx", "url"), responses).select("idx.*", "*").drop("idx", "error")
