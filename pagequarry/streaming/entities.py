"""Entities of pages that arrive as a stream, merged into the stored ones batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagequarry.functions.rules import ENTITY_PATTERNS
from pagequarry.operators.entities import extracted
from pagequarry.sources import entity_store

PAGES = "project string, page_id long, crawled_at timestamp, title string, meta_description string, content_text string, headings array<string>"


def merge(spark: SparkSession, stream: DataFrame, store: str, checkpoint: str, delay: str = "1 day", least: float = 0.5, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS), ascii_words: bool = False) -> StreamingQuery:
    """Extract the entities of ``stream(project, page_id, crawled_at, title, ...)`` and merge them into the store; one query writes a store.

    A page that comes again within ``delay`` of its first ``crawled_at`` counts once: its key is kept as state until the watermark has
    passed. Each batch is a run named by its number, and a repeated batch changes nothing. Merging does not depend on order, so
    however the pages are cut into batches, and however late they come, the store ends up the same.
    """
    once = stream.withWatermark("crawled_at", delay).dropDuplicatesWithinWatermark(["project", "page_id"])

    def batch(pages: DataFrame, number: int) -> None:
        found = extracted(pages.drop("crawled_at"), least, kinds, ascii_words=ascii_words)
        entity_store.upsert(pages.sparkSession, store, found.select("project", "entity_type", "value", "confidence", "context", "ord"), f"{checkpoint}#{number}")

    return once.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start(spark: SparkSession, folder: str, store: str, checkpoint: str, files: int = 1000, **options) -> StreamingQuery:
    """``merge`` of the page files that arrive in ``folder``, so many a batch at most."""
    return merge(spark, spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files).parquet(folder), store, checkpoint, **options)
