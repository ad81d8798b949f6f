"""What happens to extracted articles: dedup, validation, names, index and report."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagewright.functions import texts


def dedup(articles: DataFrame, text: str = "content_text", order: str = "seq") -> DataFrame:
    """Rows without later ones of equal content; the first by ``order`` stays.

    Texts under 100 characters (white space around not counted) and nulls all stay.
    """
    short = F.coalesce(F.length(texts.stripped(F.col(text))), F.lit(0)) < 100
    marked = articles.withColumn("_short", short).withColumn("_hash", F.when(~short, texts.content_hash(F.col(text))))
    # short texts would be one hot key: they don't take part in the shuffle
    long = marked.where("not _short").withColumn("_n", F.row_number().over(W.partitionBy("_hash").orderBy(order))).where("_n = 1")
    return marked.where("_short").drop("_short", "_hash").unionByName(long.drop("_short", "_hash", "_n"))


def skip_reason(url: str = "url", text: str = "content_text") -> F.Column:
    """Why a row is no valid article; null if it is one."""
    return F.when(F.coalesce(F.trim(F.col(url)), F.lit("")) == "", "missing url").when(texts.word_count(F.col(text)) < 10, "content too short (<10 words)")


def validate(articles: DataFrame, url: str = "url", text: str = "content_text") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and ``url, reason`` of the others."""
    marked = articles.withColumn("_reason", skip_reason(url, text))
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").select(F.col(url).alias("url"), F.col("_reason").alias("reason"))


def unique_slugs(articles: DataFrame, slug: str = "slug", order: str = "seq") -> DataFrame:
    """``slug`` made unique in arrival order: the first of -2, -3 and so on that no earlier row has is added to one that is taken.

    Only slugs of one family (equal but for numbers at the end) can meet, so a
    family is a group. Slugs of one row, nearly all, are settled by a count; the
    others' families are numbered on slim rows of slug and order alone. Rows without an
    order come last; those of one slug and order get their names as they come.
    """
    family = F.regexp_replace(F.col(slug), r"(-[0-9]+)+$", "")
    slim = articles.select(family.alias("family"), F.col(slug).alias("name"), F.col(order).cast("long").alias("at"))
    again = slim.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.regexp_replace("name", r"(-[0-9]+)+$", "").alias("family")).distinct()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken, following = None, set(), {}
        for batch in batches:
            out = []
            for f, name in zip(batch.column("family").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if f != last:
                    last, taken, following = f, set(), {}
                new, n = name, following.get(name, 2)
                while new in taken:
                    new, n = f"{name}-{n}", n + 1
                following[name] = n
                taken.add(new)
                out.append(new)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("at"), pa.array(out, pa.string())], ["_name", "_at", "_new"])

    # a shuffle of its own: that of the join may be read in parts, in which families are cut
    rows = slim.join(again, "family", "left_semi").repartition(F.xxhash64("family")).sortWithinPartitions("family", F.col("at").asc_nulls_last()).select("family", "name", "at")
    at = lambda c: F.coalesce(F.col(c).cast("long").cast("string"), F.lit(""))
    # one row a slug and order, so that nothing is repeated by the join
    named = rows.mapInArrow(number, "_name string, _at long, _new string").groupBy("_name", at("_at").alias("_key")).agg(F.collect_list("_new").alias("_new")).where("size(_new) > 1 or _new[0] <> _name")
    joined = articles.withColumn("_place", at(order)).join(named, (F.col(slug) == F.col("_name")) & (F.col("_place") == F.col("_key")), "left")
    joined = joined.withColumn("_n", F.row_number().over(W.partitionBy(slug, "_place").orderBy(F.lit(1))))
    return joined.withColumn(slug, F.coalesce(F.expr("_new[_n - 1]"), slug)).drop("_name", "_key", "_new", "_place", "_n")


def index(articles: DataFrame, order: str = "seq") -> DataFrame:
    """The articles' index, newest first; those without a date come last, in arrival order."""
    columns = "slug url title author published_at summary tags word_count reading_time_minutes extraction_method_used".split()
    return articles.orderBy(F.coalesce("published_at", F.lit("")).desc(), order).select(*columns)


def report(articles: DataFrame, skipped: DataFrame) -> DataFrame:
    """``section, name, value``: totals, articles by method and skipped rows by reason."""
    totals = articles.agg(F.count("*").alias("articles"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words"), F.coalesce(F.sum("reading_time_minutes"), F.lit(0)).alias("minutes"))
    totals = totals.selectExpr("stack(4, 'articles', articles, 'words', words, 'minutes', minutes, 'average words', case when articles > 0 then words div articles end) as (name, value)").where("value is not null")
    by = lambda df, column: df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("value"))
    parts = [("total", totals), ("method", by(articles, "extraction_method_used")), ("skipped", by(skipped.dropDuplicates(["url", "reason"]), "reason"))]
    out = None
    for section, df in parts:
        df = df.select(F.lit(section).alias("section"), "name", F.col("value").cast("long").alias("value"))
        out = df if out is None else out.unionByName(df)
    return out
