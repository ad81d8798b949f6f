"""Walking a link graph level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import pages as page_ops
from pagewright.operators.fetching import response_guard
from pagewright.plans.cut import cut, stored


def depths(edges: DataFrame, start: list[str] | DataFrame, most: int = 10) -> DataFrame:
    """``node, depth`` of what ``src, dst`` edges reach from the start in ``most`` steps, each node at its least depth.

    The start is a list, or a table with a column ``node`` where it is long.
    Null ends lead nowhere; repeated edges and cycles don't matter. Each level
    joins the new nodes only, and what was seen is an anti-join.
    """
    spark = edges.sparkSession
    if isinstance(start, DataFrame):
        seen = start.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0))
    else:
        seen = spark.createDataFrame([(x, 0) for x in dict.fromkeys(start)], "node string, depth int")
    front = seen
    for depth in range(1, most + 1):
        found = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).where("node is not null").distinct()
        front = cut(found.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


@dataclass
class Crawled:
    """``articles``, ``skipped`` (url, reason) and ``seen`` (norm_url) of a crawl."""

    articles: DataFrame
    skipped: DataFrame
    seen: DataFrame


#: Priorities of what is found: sitemaps, the start, the next page of a list, links.
SITEMAP, START, NEXT, LINK = 8, 5, 5, 0


def discover(read: DataFrame, seen: DataFrame, domains: list[str], budget: int | None = None, subdomains: bool = False, exclude: str | None = None) -> DataFrame:
    """``url, norm_url, priority``: addresses to go to from pages (url, seq, next_url, links), each new one once.

    The next page of a list comes before links, then the order of pages and of
    links on them; ``budget`` keeps that many of the first. What is ``seen``
    (norm_url), elsewhere, no web page or excluded is left out.
    """
    found = read.select(
        "url", "seq",
        F.explode(F.concat(
            F.when(F.col("next_url").isNotNull(), F.array(F.struct(F.lit(NEXT).alias("priority"), F.lit(-1).alias("pos"), F.col("next_url").alias("href")))).otherwise(F.array()),
            F.transform(F.coalesce("links", F.array()), lambda x, i: F.struct(F.lit(LINK).alias("priority"), i.alias("pos"), x["href"].alias("href"))),
        )).alias("x"),
    ).select("seq", "x.*")
    found = found.withColumn("norm_url", urls.normalize_url(F.col("href"))).where(urls.crawlable(F.col("href"), domains, subdomains, exclude))
    # aggregated before it is compared, so a link on every page is one row a task
    first = found.groupBy("norm_url").agg(F.min(F.struct((-F.col("priority")).alias("p"), "seq", "pos", "href")).alias("x"))
    new = first.join(seen.select("norm_url"), "norm_url", "left_anti").select(F.col("x.href").alias("url"), "norm_url", (-F.col("x.p")).alias("priority"), "x.seq", "x.pos")
    return new if budget is None else new.orderBy(F.col("priority").desc(), "seq", "pos").limit(budget)


def crawl(
    responses: DataFrame, start: list[str], domains: list[str] | None = None, max_depth: int = 10, max_pages: int | None = 500, seen: DataFrame | None = None,
    sitemaps: DataFrame | None = None, subdomains: bool = False, include: str | None = None, exclude: str | None = None, least: int = 35,
) -> Crawled:
    """A crawl over a table of responses (url, status, content_type, html), level by level.

    ``seen`` (norm_url) is what earlier crawls went to; ``sitemaps`` (url) are
    addresses to begin with besides the start, which alone doesn't count for
    ``max_pages``. Each level joins the responses by normalised address, reads
    every page once, and writes its rows to the shared folder. Addresses
    without a response are skipped as ``no_response``.
    """
    spark = responses.sparkSession
    domains = domains or sorted({u.split("/")[2].lower() for u in start if u.count("/") >= 2})
    page = responses.withColumn("norm_url", urls.normalize_url(F.col("url"))).groupBy("norm_url").agg(F.max(F.struct((F.col("status") == 200).alias("ok"), "status", "content_type", "html")).alias("r")).select("norm_url", "r.status", "r.content_type", "r.html")
    page = stored(page)
    seen = spark.createDataFrame([], "norm_url string") if seen is None else seen.select("norm_url").distinct()
    front = spark.createDataFrame([(u, START, i, -1) for i, u in enumerate(start)], "url string, priority int, seq long, pos int").withColumn("norm_url", urls.normalize_url(F.col("url"))).dropDuplicates(["norm_url"])
    left = max_pages
    if sitemaps is not None:
        named = sitemaps.select("url").where(urls.crawlable(F.col("url"), domains, subdomains, exclude)).withColumn("norm_url", urls.normalize_url(F.col("url")))
        named = named.groupBy("norm_url").agg(F.min("url").alias("url")).join(seen, "norm_url", "left_anti").join(front.select("norm_url"), "norm_url", "left_anti")
        named = named.orderBy("norm_url") if left is None else named.orderBy("norm_url").limit(left)
        named = cut(named.select("url", F.lit(SITEMAP).alias("priority"), F.lit(0).cast("long").alias("seq"), F.lit(-1).alias("pos"), "norm_url"))
        left = None if left is None else left - named.count()
        front = front.unionByName(named)
    kept = lost = None
    for depth in range(max_depth + 1):
        order = F.row_number().over(W.orderBy(F.col("priority").desc(), "seq", "pos"))
        front = cut(front.withColumn("seq", order.cast("long")) if left is not None else front)
        seen = cut(seen.unionByName(front.select("norm_url")).distinct())
        got = front.select("url", "norm_url", "seq").join(page, "norm_url", "left").withColumn("reason", F.when(F.col("status").isNull(), "no_response").otherwise(response_guard()))
        bad = got.where("reason is not null").select("url", "reason")
        read = stored(page_ops.extract(got.where("reason is null").select("url", "seq", "html")).withColumn("depth", F.lit(depth)))
        good, poor = page_ops.accepted(read, least, include)
        skipped = stored(bad.unionByName(poor))
        kept, lost = (good, skipped) if kept is None else (kept.unionByName(good), lost.unionByName(skipped))
        if depth == max_depth or left == 0:
            break
        front = cut(discover(read, seen, domains, left, subdomains, exclude))
        n = front.count()
        if not n:
            break
        left = None if left is None else left - n
    return Crawled(kept, lost, seen)
