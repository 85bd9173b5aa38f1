"""The entity store across runs, and jobs that move through states, fail, are cut off and run again."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.operators import entities
from pagequarry.sources import entity_store, runs

FOUND = "project string, entity_type string, value string, confidence double, context string, ord long"
COLUMNS = ["project", "entity_type", "normalized_value", "value", "confidence", "context", "frequency"]


def finds(seed, start, n=300):
    rng = random.Random(seed)
    # Confidences differ, so the most confident find is one.
    return [(rng.choice(["p", "p", "q", None]), rng.choice(["brand", "price"]), rng.choice(["The Acme Inc", "acme", " Globex", "x", ""]), (start + i) * 37 % 1009 / 1009, f"c{start + i}", start + i) for i in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_two_runs_are_one(spark, tmp_path):
    a, b = finds(1, 0), finds(2, 1000)
    path = str(tmp_path / "store")
    frame = lambda x: spark.createDataFrame(x, FOUND)
    entity_store.upsert(spark, path, frame(a), "r1")
    entity_store.upsert(spark, path, frame(b), "r2")
    want = rows(entities.store(frame(a + b)))
    assert rows(entity_store.read(spark, path)) == want
    other = str(tmp_path / "other")
    for run, x in (("r2", b), ("r1", a)):
        entity_store.upsert(spark, other, frame(x), run)
    assert rows(entity_store.read(spark, other)) == want
    # A repeated run and a run without finds change nothing; a project's own run leaves others' folders alone.
    entity_store.upsert(spark, path, frame(b), "r2")
    entity_store.upsert(spark, path, frame([]), "r3")
    assert rows(entity_store.read(spark, path)) == want
    files = {r.f for r in entity_store.read(spark, path).filter("project = 'p'").select(F.input_file_name().alias("f")).distinct().collect()}
    entity_store.upsert(spark, path, frame([("new", "brand", "Initech", 0.5, "c", 1)]), "r4")
    kept = entity_store.read(spark, path)
    assert {r.f for r in kept.filter("project = 'p'").select(F.input_file_name().alias("f")).distinct().collect()} == files
    assert kept.filter("project = 'new'").first()["first_run"] == "r4" and kept.select("entity_id").distinct().count() == kept.count()


def test_a_run_cut_off_is_finished(spark, tmp_path, monkeypatch):
    a, b = finds(1, 0), finds(2, 1000)
    path = str(tmp_path / "store")
    frame = lambda x: spark.createDataFrame(x, FOUND)
    entity_store.upsert(spark, path, frame(a), "r1")
    whole = entity_store._replace

    def broken(spark, path, ready):
        raise KeyboardInterrupt

    monkeypatch.setattr(entity_store, "_replace", broken)
    with pytest.raises(KeyboardInterrupt):
        entity_store.upsert(spark, path, frame(b), "r2")
    assert rows(entity_store.read(spark, path)) == rows(entities.store(frame(a)))
    monkeypatch.setattr(entity_store, "_replace", whole)
    entity_store.upsert(spark, path, frame(b), "r2")
    assert rows(entity_store.read(spark, path)) == rows(entities.store(frame(a + b)))


PAGE = '<html><head><title>Acme Software</title></head><body><main>Starting at $5 per month. <a href="/b">next</a> <a href="/gone">x</a></main></body></html>'


def test_jobs_from_start_to_end(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    ask = lambda *xs: spark.createDataFrame([(*x, {}) for x in xs], "project string, job_id string, base_url string, settings map<string,string>")
    got = runs.submit(spark, path, "crawl", ask(("a", "1", "http://a.com/"), ("a", "2", "http://a.com/"), ("b", "3", "nonsense"), ("c", "4", "http://c.com/"), ("d", "5", "http://d.com/no")))
    assert {tuple(r) for r in got.collect()} == {("a", "1", "started"), ("a", "1", "already_running"), ("b", "3", "started"), ("c", "4", "started"), ("d", "5", "started")}
    recorded = spark.createDataFrame([("http://a.com/", 1, 200, 0.1, PAGE, None), ("http://a.com/b", 1, 200, 0.1, "<title>B</title>", None)], "url string, attempt int, status int, seconds double, html string, error string")
    robots = spark.createDataFrame([("d.com", "/no", False, 0)], "host string, prefix string, allow boolean, ord int")
    assert runs.status(spark, path, "crawl", "a").first().status == "pending" and runs.status(spark, path, "crawl", "z").isEmpty()

    whole = runs.write

    def cut_off(rows, path):
        whole(rows.limit(1), path)
        raise KeyboardInterrupt

    monkeypatch.setattr(runs, "write", cut_off)
    with pytest.raises(KeyboardInterrupt):
        runs.run_crawls(spark, path, recorded, robots)
    assert runs.status(spark, path, "crawl", "a").first().status == "running" and runs.pages(spark, path).isEmpty()
    again = runs.submit(spark, path, "crawl", ask(("a", "9", "http://a.com/"))).first()
    assert (again.job_id, again.status) == ("1", "already_running")
    monkeypatch.setattr(runs, "write", whole)
    runs.run_crawls(spark, path, recorded, robots)
    now = {r.job_id: (r.status, r.attempt, r.pages_crawled, r.pages_failed, r.total_pages_found, r.error_message) for r in runs.current(runs.states(spark, path)).collect()}
    assert now == {
        "1": ("completed", 2, 2, 1, 2, None), "3": ("failed", 2, 0, 0, 0, "Invalid URL: nonsense"), "4": ("completed", 2, 0, 1, 0, None), "5": ("failed", 2, 0, 0, 0, "Robots.txt disallows crawling: http://d.com/no"),
    }
    pages = {(r.job_id, r.url, r.status, r.title, r.error_message) for r in runs.pages(spark, path).collect()}
    assert pages == {("1", "http://a.com/", "crawled", "Acme Software", None), ("1", "http://a.com/b", "crawled", "B", None), ("1", "http://a.com/gone", "failed", None, "not found"), ("4", "http://c.com/", "failed", None, "not found")}
    one = runs.status(spark, path, "crawl", "a").first()
    assert one.started_at <= one.completed_at and one.created_at <= one.started_at and one.current_progress is None

    runs.submit(spark, path, "extract", ask(("a", "e1", None), ("c", "e2", None)))
    replace = entity_store._replace
    monkeypatch.setattr(entity_store, "_replace", lambda *x: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        runs.run_extractions(spark, path)
    monkeypatch.setattr(entity_store, "_replace", replace)
    runs.run_extractions(spark, path)
    stored = rows(entity_store.read(spark, f"{path}/store"))
    done = runs.status(spark, path, "extract", "a", "e1").first()
    assert (done.status, done.pages_processed) == ("completed", 2) and done.entities_found >= len(stored) > 0 and all(r[6] >= 1 for r in stored)
    assert runs.status(spark, path, "extract", "c").first().error_message == "No crawled pages found for this project"
    # Work that raises fails its jobs with the message.
    runs.submit(spark, path, "extract", ask(("a", "e3", None)))
    monkeypatch.setattr(entities, "extracted", lambda *x: (_ for _ in ()).throw(ValueError("no rules")))
    runs.run_extractions(spark, path)
    assert runs.status(spark, path, "extract", "a").first().error_message == "no rules" and rows(entity_store.read(spark, f"{path}/store")) == stored
