"""Pages that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagewright.functions import texts
from pagewright.operators import articles, pages


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of (page_id, url, html) as they come into a folder."""
    return spark.readStream.schema("page_id long, url string, html string").parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Extract, dedup, validate and append what is new; content that earlier batches had is left out.

    Every batch is anti-joined with the digests written before it, so state is
    the output itself and a batch that is repeated after a failure writes its
    own folder again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = articles.dedup(pages.extract(batch).withColumn("seq", F.col("page_id"))).withColumn("digest", F.when(F.length(texts.stripped(F.col("content_text"))) >= 100, texts.content_hash(F.col("content_text"))))
        if number:
            written = spark.read.schema("digest string, batch long").parquet(out).where(F.col("batch") < number).select("digest").where("digest is not null")
            new = new.join(written, "digest", "left_anti")
        new, _ = articles.validate(new)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
