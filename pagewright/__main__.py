"""Command line: a crawl over a table of responses, or over HTTP, to articles, index, logs and a report."""

from __future__ import annotations

import argparse
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.operators import articles as ops
from pagewright.plans import crawl
from pagewright.plans.cut import stored
from pagewright.sources import fetching, sinks


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser("pagewright", description=__doc__)
    p.add_argument("--url", action="append", required=True, help="where the crawl starts; may be repeated")
    p.add_argument("--out", default="./out", help="folder for all results, shared by the executors")
    p.add_argument("--responses", help="Parquet of url, status, content_type, html; without it the start pages are fetched over HTTP")
    p.add_argument("--max-pages", type=int, default=500)
    p.add_argument("--max-depth", type=int, default=10)
    p.add_argument("--domains", default="", help="more domains than the start's, by commas")
    p.add_argument("--allow-subdomains", action="store_true")
    p.add_argument("--include-regex")
    p.add_argument("--exclude-regex")
    p.add_argument("--min-score", type=int, default=35)
    p.add_argument("--resume", action="store_true", help="leave out what earlier runs in the same folder went to")
    p.add_argument("--files", action="store_true", help="write a JSON and a Markdown file an article besides the tables")
    return p.parse_args(argv)


def checked(pattern: str | None) -> str | None:
    """The pattern if Python and Spark can both read it; ``ValueError`` otherwise."""
    if pattern:
        try:
            re.compile(pattern)
            SparkSession.active().range(1).select(F.lit("x").rlike(pattern)).collect()
        except Exception as e:
            raise ValueError(f"bad pattern {pattern!r}: {e}") from e
    return pattern


def domain_set(start: list[str], more: str = "") -> list[str]:
    """Hosts of the start and of a list by commas, in lower case."""
    return sorted({u.split("/")[2].lower() for u in start if u.count("/") >= 2} | {d.strip().lower() for d in more.split(",") if d.strip()})


def summary(articles: DataFrame, skipped: DataFrame) -> str:
    """The report as text: totals, then methods and skip reasons by number and name. Reads aggregates only."""
    rows = ops.report(articles, skipped).collect()
    out = []
    for title, section in (("Totals", "total"), ("By method", "method"), ("Skipped", "skipped")):
        own = [(r["name"] or "unknown", r["value"]) for r in rows if r["section"] == section]
        own = own if section == "total" else sorted(own, key=lambda x: (-x[1], x[0]))
        out += [title, *(f"  {name:<40} {value:>12,}" for name, value in own), ""]
    return "\n".join(out)


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    spark = SparkSession.builder.appName("pagewright").getOrCreate()
    try:
        include, exclude = checked(a.include_regex), checked(a.exclude_regex)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    if a.responses:
        responses = spark.read.parquet(a.responses)
    else:
        starts = spark.createDataFrame([(u,) for u in a.url], "url string")
        responses = stored(fetching.fetch_pages(starts).select("url", "status", F.lit("text/html").alias("content_type"), "html"))
    seen = sinks.read_seen(spark, f"{a.out}/seen_urls", f"{a.out}/index.json") if a.resume else None
    done = crawl.crawl(responses, a.url, domain_set(a.url, a.domains), a.max_depth, a.max_pages, seen, None, a.allow_subdomains, include, exclude, a.min_score)
    found = done.articles.withColumn("arrival", F.col("depth") * F.lit(1 << 40) + F.col("seq"))
    good, bad = ops.validate(ops.dedup(found, order="arrival"))
    good = stored(ops.unique_slugs(good, order="arrival"))
    skipped = stored(done.skipped.unionByName(bad))
    sinks.write_articles(good, f"{a.out}/articles")
    sinks.write_index(good, a.out, "arrival")
    sinks.write_skipped(skipped, f"{a.out}/skipped")
    sinks.write_seen(done.seen, f"{a.out}/seen_urls")
    if a.files:
        sinks.write_files(good, f"{a.out}/files")
    print(summary(good, skipped))
    return 0


if __name__ == "__main__":
    sys.exit(main())
