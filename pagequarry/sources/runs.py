"""Crawl and extraction jobs that move through states, and the rows they leave.

A state is a row added to a table, so nothing that other jobs do is overwritten and the way of a job can be read. An attempt's rows
are kept under its number; only those of a job's last completed attempt are its rows. A job that was cut off and
runs again thus leaves what one run leaves.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators import crawl, entities, jobs
from pagequarry.operators.html import parse_pages
from pagequarry.sources import entity_store
from pagequarry.sources.tables import stored

STATE = "kind string, project string, job_id string, attempt int, status string, at timestamp, base_url string, settings map<string,string>, pages_crawled long, pages_failed long, total_pages_found long, entities_found long, pages_processed long, current_url string, error_message string"
#: The states in their order; a job goes on to a later one only, but for another attempt.
ORDER = ("pending", "running", "completed", "failed")


def add(states: DataFrame, path: str) -> None:
    """Add rows with columns of STATE to the states at ``path``; those left out are null."""
    spark = states.sparkSession
    have = set(states.columns)
    columns = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], STATE).schema]
    states.select(*columns).write.mode("append").parquet(f"{path}/states")


def states(spark: SparkSession, path: str) -> DataFrame:
    there = entity_store.exists(spark, f"{path}/states")
    return spark.read.schema(STATE).parquet(f"{path}/states") if there else spark.createDataFrame([], STATE)


def current(rows: DataFrame) -> DataFrame:
    """One row a job: its last state, its settings, and when it was made, begun and ended.

    The last state is that of the greatest attempt, then the later by ORDER and time. Counts are the last that were told in that attempt.
    """
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("status"))
    order = F.struct("attempt", rank, "at")
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.struct("attempt", c)), F.when(F.col(c).isNotNull(), order)).alias(f"last_{c}")
    told = ("pages_crawled", "pages_failed", "total_pages_found", "entities_found", "pages_processed", "current_url", "error_message")
    began = F.max(F.when(F.col("status") == "running", F.struct("attempt", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("early"), "at")))
    one = rows.groupBy("kind", "project", "job_id").agg(
        F.max("attempt").alias("attempt"), F.max_by("status", order).alias("status"), F.max_by("at", order).alias("last_at"), F.min("at").alias("created_at"),
        began.alias("began"), F.max_by("base_url", F.when(F.col("base_url").isNotNull(), order)).alias("base_url"), F.max_by("settings", F.when(F.col("settings").isNotNull(), order)).alias("settings"), *map(last, told),
    )
    now = [F.when(F.col(f"last_{c}.attempt") == F.col("attempt"), F.col(f"last_{c}.{c}")).alias(c) for c in told]
    over = F.col("status").isin("completed", "failed")
    return one.select("kind", "project", "job_id", "attempt", "status", "base_url", "settings", "created_at", F.when(F.col("began.attempt") == F.col("attempt"), F.col("began.at")).alias("started_at"), F.when(over, F.col("last_at")).alias("completed_at"), *now)


def _now() -> Column:
    return F.lit(datetime.datetime.now(datetime.timezone.utc))


def submit(spark: SparkSession, path: str, kind: str, asked: DataFrame, force: bool = False) -> DataFrame:
    """Enter jobs ``asked(project, job_id, base_url, settings)``: ``(project, job_id, status)`` of each.

    ``started``, or ``already_running`` with the job at work of the same kind; of several asked for one project
    the first by id starts. ``force`` starts all.
    """
    rows = asked.select("project", "job_id", *[c for c in ("base_url", "settings") if c in asked.columns])
    if force:
        new, told = rows, rows.select("project", "job_id", F.lit("started").alias("status"))
    else:
        work = current(states(spark, path)).filter((F.col("kind") == kind) & F.col("status").isin(*jobs.ACTIVE)).groupBy("project").agg(F.min("job_id").alias("_busy"))
        first = rows.groupBy("project").agg(F.min("job_id").alias("_first"))
        of = rows.join(work, "project", "left").join(first, "project").withColumn("_by", F.coalesce("_busy", "_first"))
        starts = F.col("_busy").isNull() & (F.col("job_id") == F.col("_first"))
        of = stored(of.withColumn("_starts", starts), "asked")
        new = of.filter("_starts").drop("_busy", "_first", "_by", "_starts")
        told = of.select("project", F.when(F.col("_starts"), F.col("job_id")).otherwise(F.col("_by")).alias("job_id"), F.when(F.col("_starts"), "started").otherwise("already_running").alias("status"))
    add(new.withColumns({"kind": F.lit(kind), "attempt": F.lit(1), "status": F.lit("pending"), "at": _now()}), path)
    return told


def take(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The jobs of a kind to be run, now ``running``: those pending, and those that an earlier run left running, as a new attempt."""
    found = current(states(spark, path)).filter((F.col("kind") == kind) & F.col("status").isin(*jobs.ACTIVE))
    taken = stored(found.withColumn("attempt", F.col("attempt") + F.when(F.col("status") == "running", 1).otherwise(0)).select("kind", "project", "job_id", "attempt", "base_url", "settings"), "taken")
    add(taken.withColumns({"status": F.lit("running"), "at": _now()}), path)
    return taken


def finish(spark: SparkSession, path: str, taken: DataFrame, work: Callable[[DataFrame], DataFrame]) -> None:
    """Run ``work(taken)``, which gives ``(job_id, error_message, counts...)``; jobs with a message have failed, the others are completed.

    If the work raises, all of them have failed with its message; interrupts are let through, so that the jobs stay at work.
    """
    try:
        done = stored(work(taken), "done")
        state = F.when(F.col("error_message").isNull(), "completed").otherwise("failed")
        add(taken.join(done, "job_id").withColumns({"status": state, "at": _now()}), path)
    except Exception as error:  # the message is the job's result
        add(taken.withColumns({"status": F.lit("failed"), "error_message": F.lit(str(error)[:2000]), "at": _now()}), path)


def setting(name: str, kind: str, default) -> Column:
    return F.coalesce(F.try_element_at("settings", F.lit(name)).cast(kind), F.lit(default))


def run_crawls(spark: SparkSession, path: str, recorded: DataFrame, robots: DataFrame | None = None, max_pages: int = 50, delay: float = 1.0, timeout: float = 30.0, attempts: int = 1) -> None:
    """Run all crawl jobs to be run, together, from ``recorded`` responses; pages go to ``pages`` under the job's id and attempt.

    A base address that is no address, or that the robots rules refuse, fails its job.
    """

    def work(taken: DataFrame) -> DataFrame:
        base = taken.select("job_id", "project", "attempt", urls.normalize("base_url").alias("url"), F.col("base_url").alias("given"))
        free = base.filter("url is not null")
        if robots is not None:
            free = crawl.allowed(free, robots)
        error = F.when(F.col("url").isNull(), F.concat(F.lit("Invalid URL: "), F.coalesce("given", F.lit("")))).when(F.col("free").isNull(), F.concat(F.lit("Robots.txt disallows crawling: "), F.col("url")))
        gate = base.join(free.select("job_id", F.lit(True).alias("free")), "job_id", "left").withColumn("error_message", error)
        # A job is a project of its own here: two jobs of one project keep their pages apart.
        seeds = gate.filter("error_message is null").select(F.col("job_id").alias("project"), "url")
        got = stored(crawl.crawl_recorded(recorded, seeds, robots, max_pages, delay, timeout, attempts), "got")
        rows = got.withColumnRenamed("project", "job_id").join(base.select("job_id", "project", "attempt"), "job_id")
        write(pages_of(rows.filter("status <> 'queued'")), f"{path}/pages")
        counts = crawl.progress(got).withColumnRenamed("project", "job_id")
        last = got.filter("status = 'crawled'").groupBy(F.col("project").alias("job_id")).agg(F.max_by("url", "due").alias("current_url"))
        filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pages_crawled", "pages_failed", "total_pages_found")]
        return gate.join(counts, "job_id", "left").join(last, "job_id", "left").select("job_id", "error_message", "current_url", *filled)

    finish(spark, path, take(spark, path, "crawl"), work)


def pages_of(rows: DataFrame) -> DataFrame:
    """Fetched rows with what their HTML holds: title, description, content, headings and type."""
    from pagequarry.streaming.pages import classified

    keys = ["job_id", "project", "attempt", "url", "depth", "status", "http_status_code", "error_message"]
    flat = stored(rows.select(*keys, "html").withColumn("page_id", F.xxhash64("job_id", "attempt", "url")), "fetched")
    parsed = parse_pages(flat.filter("html is not null").select("page_id", "url", "html")).select("page_id", "title", "meta_description", F.col("content").alias("content_text"), "headings")
    kinds = classified(flat.filter("html is not null")).select("page_id", "page_type", "confidence")
    return flat.drop("html").join(parsed.join(kinds, "page_id"), "page_id", "left")


def write(rows: DataFrame, path: str) -> None:
    """Rows with ``job_id`` and ``attempt`` in folders of their own; a repeated attempt replaces its rows."""
    rows.withColumn("job", F.col("job_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job", "attempt").parquet(path)


def pages(spark: SparkSession, path: str) -> DataFrame:
    """The pages of each crawl job's last attempt, if it is completed."""
    done = current(states(spark, path)).filter("kind = 'crawl' and status = 'completed'").select("job_id", "attempt")
    return spark.read.parquet(f"{path}/pages").drop("job").join(done, ["job_id", "attempt"])


def run_extractions(spark: SparkSession, path: str, least: float = 0.5, kinds: tuple[str, ...] = tuple(entities.ENTITY_PATTERNS)) -> None:
    """Run all extraction jobs to be run, together, over their projects' newest completed crawls; entities are merged into those stored.

    A project without crawled pages fails its job.
    """

    def work(taken: DataFrame) -> DataFrame:
        newest = current(states(spark, path)).filter("kind = 'crawl' and status = 'completed'").groupBy("project").agg(F.max_by("job_id", F.struct("created_at", "job_id")).alias("crawl_id"))
        done = pages(spark, path).filter("status = 'crawled'").drop("project", "attempt", "depth").withColumnRenamed("job_id", "crawl_id")
        own = done.join(newest.join(taken.select("project", F.col("job_id").alias("own_job")), "project"), "crawl_id")
        own = stored(own.select("project", "own_job", "page_id", "title", "meta_description", "content_text", "headings"), "own")
        found = stored(entities.extracted(own.drop("own_job"), least, kinds), "found")
        # A project's run is named by its job, so that one which is repeated is known.
        named = found.join(taken.select("project", F.col("job_id").alias("run")), "project")
        entity_store.upsert(spark, f"{path}/store", named.select("project", "entity_type", "value", "confidence", "context", "ord", "run"))
        n = own.groupBy("own_job").agg(F.count("*").alias("pages_processed")).join(found.groupBy("project").agg(F.count("*").alias("entities_found")).join(taken.select("project", F.col("job_id").alias("own_job")), "project"), "own_job", "left")
        out = taken.select("job_id").join(n.withColumnRenamed("own_job", "job_id"), "job_id", "left")
        none = F.when(F.col("pages_processed").isNull(), "No crawled pages found for this project")
        return out.select("job_id", none.alias("error_message"), F.coalesce("pages_processed", F.lit(0)).alias("pages_processed"), F.coalesce("entities_found", F.lit(0)).alias("entities_found"))

    finish(spark, path, take(spark, path, "extract"), work)


def status(spark: SparkSession, path: str, kind: str, project: str, job_id: str | None = None) -> DataFrame:
    """A project's job of that id, else its newest, with its counts, its error and, while it is at work, how far it is; no rows if there is none."""
    own = current(states(spark, path)).filter((F.col("kind") == kind) & (F.col("project") == project))
    own = own.filter(F.col("job_id") == job_id) if job_id is not None else own.orderBy(F.desc("created_at"), F.desc("job_id")).limit(1)
    doing = F.when(F.col("status").isin(*jobs.ACTIVE) & F.col("current_url").isNotNull(), F.concat(F.lit("Currently crawling: "), F.col("current_url")))
    return own.withColumn("current_progress", doing)
