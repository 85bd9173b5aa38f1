"""Where intermediate results go: the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from pagequarry.sources.tables import shared_dir, unused

__all__ = ["cut", "shared_dir", "stage", "unused"]


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freed(spark: SparkSession):
    """What runs here leaves no shuffle files; they would stay until the driver happens to collect its garbage, which may be never."""
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


def cut(df: DataFrame) -> DataFrame:
    """Run ``df`` once and go on from a reliable checkpoint of its rows."""
    shared_dir(df.sparkSession)
    with _freed(df.sparkSession):
        # A plan of its own: whether shuffle files go is settled when a plan is made.
        return df.select("*").checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Run ``df`` once, as Parquet in the shared folder; later reads prune its columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
