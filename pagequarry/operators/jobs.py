"""Crawl and extraction jobs as a table ``(project, job_id, status, created_at, ...)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The states in which a job is at work, and the ranges of a crawl's settings.
ACTIVE = ("pending", "running")
RANGES = {"max_pages": (1, 500), "delay_seconds": (0.1, 10.0), "timeout_seconds": (10, 120)}


def checked(max_pages: int = 50, delay_seconds: float = 1.0, timeout_seconds: int = 30) -> dict[str, float]:
    """A crawl's settings; ``ValueError`` names the first that is out of range."""
    given = {"max_pages": max_pages, "delay_seconds": delay_seconds, "timeout_seconds": timeout_seconds}
    for name, value in given.items():
        low, high = RANGES[name]
        if not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
    return given


def latest(jobs: DataFrame) -> DataFrame:
    """Each project's newest job; of equal times the greater id."""
    return jobs.groupBy("project").agg(*[F.max_by(c, F.struct("created_at", "job_id")).alias(c) for c in ("job_id", "status")])


def active(jobs: DataFrame) -> DataFrame:
    """How many jobs of a project are at work; projects with none are left out."""
    return jobs.filter(F.col("status").isin(*ACTIVE)).groupBy("project").agg(F.count("*").alias("active"))


def may_start(jobs: DataFrame, project: str, force: bool = False) -> bool:
    """Whether a new job may start: no other one of the project is at work, or it is forced."""
    return force or jobs.filter((F.col("project") == project) & F.col("status").isin(*ACTIVE)).isEmpty()


def finished(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """``jobs`` with the counters of ``pages(job_id, status)``; a job at work that has pages is completed.

    Pages are counted before they meet the jobs, so a job of very many pages is one row.
    """
    counted = pages.groupBy("job_id").agg(F.count_if(F.col("status") == "crawled").alias("pages_crawled"), F.count_if(F.col("status") == "failed").alias("pages_failed"))
    base = jobs.drop("pages_crawled", "pages_failed")
    done = base.join(counted, "job_id", "left").withColumn("status", F.when(F.col("status").isin(*ACTIVE) & F.col("pages_crawled").isNotNull(), "completed").otherwise(F.col("status")))
    return done.select(*base.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pages_crawled", "pages_failed")])


def status_of(jobs: DataFrame, project: str, job_id: str | None = None) -> DataFrame:
    """The project's job of that id, else its newest; no rows if there is none."""
    own = jobs.filter(F.col("project") == project)
    return own.filter(F.col("job_id") == job_id).select("project", "job_id", "status") if job_id is not None else latest(own)
