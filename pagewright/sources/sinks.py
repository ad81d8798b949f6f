"""Writing and reading what a crawl leaves: articles, index, skip log, seen addresses."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators import articles as ops

INDEX = "slug string, url string, title string, author string, published_at string, summary string, tags array<string>, word_count int, reading_time_minutes int, extraction_method_used string"
SKIPPED = "url string, reason string, timestamp string"


def write_articles(articles: DataFrame, folder: str) -> None:
    """All articles as JSON lines in ``folder``, one file a task: the form for large tables."""
    articles.write.mode("overwrite").json(folder)


def write_files(articles: DataFrame, folder: str) -> int:
    """One ``<slug>.json`` and one ``<slug>.md`` an article, in a folder that all executors share; the number written.

    ``slug`` must be unique, as ``unique_slugs`` makes it; a task that is
    repeated writes the same files again.
    """
    rows = articles.select("slug", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("_json"), "markdown_document")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for slug, text, document in zip(*(batch.column(c).to_pylist() for c in ("slug", "_json", "markdown_document")), strict=True):
                for end, body in (("json", json.dumps(json.loads(text), indent=2, ensure_ascii=False)), ("md", document or "")):
                    path = os.path.join(folder, f"{slug.replace('/', '-')}.{end}")
                    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
                        f.write(body)
                    os.replace(f"{path}.tmp", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return rows.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def csv_index(articles: DataFrame, order: str = "seq") -> DataFrame:
    """The index as CSV can hold it: tags as a list in brackets, each in quotes."""
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce("tags", F.array()), lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))
    return ops.index(articles, order).withColumn("tags", tags)


def write_index(articles: DataFrame, folder: str, order: str = "seq") -> None:
    """``index.json`` and ``index.csv`` under ``folder``, newest first, each sorted in one file by Spark."""
    ops.index(articles, order).coalesce(1).write.mode("overwrite").json(f"{folder}/index.json", ignoreNullFields=False)
    csv_index(articles, order).coalesce(1).write.mode("overwrite").csv(f"{folder}/index.csv", header=True, quoteAll=False, escape='"')


def write_skipped(skipped: DataFrame, path: str) -> None:
    """Appends ``url, reason, timestamp`` as JSON lines."""
    skipped.select("url", "reason", F.lit(datetime.now(UTC).isoformat()).alias("timestamp")).write.mode("append").json(path)


def write_seen(seen: DataFrame, path: str) -> None:
    """Appends normalised addresses, one a line."""
    seen.select("norm_url").where("norm_url is not null").write.mode("append").text(path)


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index's rows; none if there is no file, and broken lines are left out."""
    return spark.read.schema(INDEX).option("mode", "DROPMALFORMED").json(path) if _there(spark, path) else spark.createDataFrame([], INDEX)


def read_skipped(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKIPPED).option("mode", "DROPMALFORMED").json(path) if _there(spark, path) else spark.createDataFrame([], SKIPPED)


def read_seen(spark: SparkSession, seen: str, index: str | None = None) -> DataFrame:
    """``norm_url`` of all that was gone to: the seen addresses and those of the index."""
    found = spark.read.text(seen).select(F.trim("value").alias("norm_url")) if _there(spark, seen) else spark.createDataFrame([], "norm_url string")
    if index:
        found = found.unionByName(read_index(spark, index).select(urls.normalize_url(F.col("url")).alias("norm_url")))
    return found.where("norm_url <> ''").distinct()


def read_cache(cache: DataFrame, seconds: int = 86_400, now: str | None = None) -> DataFrame:
    """Rows of a response cache (url, fetched_at, ...) that are no error and not too old, the newest of each address."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    fresh = cache.where((F.col("status") == 200) & (F.col("fetched_at") >= at - F.expr(f"interval {int(seconds)} seconds")))
    return fresh.groupBy("url").agg(F.max(F.struct("fetched_at", *[c for c in cache.columns if c not in ("url", "fetched_at")])).alias("x")).select("url", "x.*")
