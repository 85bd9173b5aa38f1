"""Pages as a stream: the batch transformations applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions.urls import path
from pagequarry.operators.classify import page_type, scores
from pagequarry.operators.html import parse_pages


def classified(pages: DataFrame) -> DataFrame:
    """``(page_id, url, title, page_type, confidence)`` of raw pages; the same for a batch and a stream."""
    parsed = parse_pages(pages.select("page_id", "url", "html"))
    text = F.lower(F.concat_ws(" ", "title", "content"))
    return parsed.select("page_id", "url", "title", text.alias("t")).select("page_id", "url", "title", page_type(scores(path(F.col("url")), F.col("t"))).alias("p")).select("page_id", "url", "title", "p.*")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Classify page files as they arrive in ``folder``; each batch is written once."""
    schema = "page_id long, url string, html string"
    stream = spark.readStream.schema(schema).parquet(folder)
    return classified(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
