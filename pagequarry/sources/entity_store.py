"""Entities kept across runs: a Parquet table in folders by project and key, into which each run's finds are merged.

An upsert reads and replaces only the folders that its finds fall in. The replaced rows are first written beside the
table, whole; a run that is cut off before that has changed nothing, and one cut off later is finished from there by the
next. A run that is repeated changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagequarry.functions.text import normalize_value
from pagequarry.sources.tables import settled

#: A project's entities lie in KEYS folders of PROJECTS * KEYS; a store keeps to one choice of these. A folder has a file for each FILE_ROWS rows of
#: an upsert, FILES at most.
PROJECTS, KEYS, FILE_ROWS, FILES = 16, 4, 1_000_000, 64
KEY = ["project", "entity_type", "normalized_value"]
SCHEMA = "project string, entity_type string, normalized_value string, value string, confidence double, context string, frequency long, first_run string, last_run string, entity_id string, first_ord array<bigint>, best_ord array<bigint>"


def folder(projects: int = PROJECTS, keys: int = KEYS) -> Column:
    """The folder of an entity; those of one project are in a row of ``keys``."""
    return (F.pmod(F.xxhash64("project"), F.lit(projects)) * keys + F.pmod(F.xxhash64("entity_type", "normalized_value"), F.lit(keys))).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, wherever the session's file systems keep it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored entities; none if nothing was stored yet."""
    rows = spark.read.schema(f"{SCHEMA}, part int")
    return rows.parquet(f"{path}/entities") if exists(spark, f"{path}/entities") else spark.createDataFrame([], f"{SCHEMA}, part int")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored entities and new ones with their ``run``, one row a project, type and normal value.

    The value is that of the first find by ord, confidence and context those of the most confident, the first if several are;
    frequencies add. So it makes no difference in which order runs come. A row that the
    new one's run has changed already stays as it is. A null is a value like others.
    """
    a, b = old.alias("a"), new.alias("b")
    same = F.lit(True)
    for k in KEY:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    fresh, again = F.col("a.entity_id").isNull(), F.col("b.run").isNull() | (F.col("a.last_run") == F.col("b.run"))
    surer = (F.col("b.confidence") > F.col("a.confidence")) | ((F.col("b.confidence") == F.col("a.confidence")) & (F.col("b.best_ord") < F.col("a.best_ord")))
    sooner = F.col("b.first_ord") < F.col("a.first_ord")
    newer = lambda c, when: F.when(when, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    pick = lambda c, changed: F.when(fresh, F.col(f"b.{c}")).when(again, F.col(f"a.{c}")).otherwise(changed).alias(c)
    both = a.join(b, same & (F.col("a.part") == F.col("b.part")), "full_outer")
    of_key = [F.when(fresh, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in KEY]
    return both.select(
        *of_key,
        pick("value", newer("value", sooner)),
        pick("confidence", F.greatest("a.confidence", "b.confidence")),
        pick("context", newer("context", surer)),
        pick("frequency", F.col("a.frequency") + F.col("b.frequency")),
        F.coalesce("a.first_run", "b.run").alias("first_run"),
        F.coalesce("b.run", "a.last_run").alias("last_run"),
        F.coalesce("a.entity_id", F.sha2(F.to_json(F.struct(*of_key)).cast("binary"), 256)).alias("entity_id"),
        pick("first_ord", F.least("a.first_ord", "b.first_ord")),
        pick("best_ord", newer("best_ord", surer)),
        F.coalesce("a.part", "b.part").alias("part"),
    )


def gathered(found: DataFrame) -> DataFrame:
    """The entities of finds as ``entities.store`` gives them, with the order of the first find and of the most confident."""
    kind = found.schema["ord"].dataType
    ord_ = F.array(*[F.col(f"ord.{f.name}").cast("long") for f in kind.fields]) if isinstance(kind, StructType) else F.array(F.col("ord").cast("long"))
    rows = found.withColumn("_ord", ord_).withColumn("normalized_value", normalize_value("value"))
    return rows.groupBy(*KEY).agg(
        F.min_by("value", "_ord").alias("value"), F.max("confidence").alias("confidence"), F.min_by("context", F.struct(-F.col("confidence"), F.col("_ord"))).alias("context"), F.count("*").alias("frequency"),
        F.min("_ord").alias("first_ord"), F.min_by("_ord", F.struct(-F.col("confidence"), F.col("_ord"))).alias("best_ord"), F.min("run").alias("run"),
    )


def _replace(spark: SparkSession, path: str, ready: str) -> None:
    """Put the folders that ``ready`` holds in the place of the table's, then drop ``ready``."""
    rows = spark.read.schema(f"{SCHEMA}, part int").parquet(ready)
    # A folder's rows are written by several tasks if they are many: one project may hold a third of all.
    files = max(1, min(FILES, rows.count() // FILE_ROWS))
    rows.repartition("part", F.pmod(F.xxhash64("normalized_value"), F.lit(files))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/entities")
    at = spark._jvm.org.apache.hadoop.fs.Path(ready)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def upsert(spark: SparkSession, path: str, found: DataFrame, run: str | None = None) -> None:
    """Merge ``found(project, entity_type, value, confidence, context, ord)``, a run's finds, into the entities at ``path``.

    ``ord`` is a number or a struct of numbers. ``run`` names the run; without it a column ``run`` of ``found`` names each
    project's. Runs follow one another, one at a time, in any order; together they give what one run over all their finds gives.
    Only the last run may be repeated. No finds change nothing.
    """
    ready = f"{path}/ready"
    if exists(spark, f"{ready}/_SUCCESS"):  # what a run that was cut off had merged
        _replace(spark, path, ready)
    rows = found if run is None else found.withColumn("run", F.lit(run))
    new = gathered(rows).withColumn("part", folder())
    new = settled(new)
    parts = [r["part"] for r in new.select("part").distinct().collect()]  # as many as there are folders, at most
    if parts:
        old = read(spark, path).filter(F.col("part").isin(parts))
        merged(old, new).write.mode("overwrite").parquet(ready)
        _replace(spark, path, ready)
