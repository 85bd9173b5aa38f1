"""Paging, one-pass totals, relation ranges, cascades, streams of entities and SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from pagequarry.functions import sql
from pagequarry.operators import entities
from pagequarry.sources import entity_store, tables
from pagequarry.streaming import entities as stream


@pytest.fixture(scope="module")
def some(spark):
    rng = random.Random(3)
    kinds = ["brand", "product", "feature", "service", "location", None]
    rows = [(rng.choice("ppq"), rng.choice(kinds), i, f"v{i}", f"id{i:04}", rng.randrange(8) / 8) for i in range(400)]
    return spark.createDataFrame(rows, "project string, entity_type string, ord long, value string, entity_id string, confidence double").withColumn("normalized_value", F.col("value"))


def test_pages_joined_are_the_ranking(spark, some, tmp_path):
    table = entities.cluster(some, str(tmp_path / "list"), 8)
    want = [r.entity_id for r in some.filter("project = 'p' and confidence >= 0.25").orderBy(F.desc("confidence"), "entity_id").collect()]
    got, after = [], None
    while True:
        rows, total, after = entities.listed(table, "p", least=0.25, limit=37, after=after)
        got += [r.entity_id for r in rows]
        assert total == len(want) and len(rows) <= 37
        if after is None:
            break
    assert got == want
    late = entities.list_page(table, "p", after=(0.25, "id0200"))
    some.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 5000)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(confidence,0.25)" in plan and "TakeOrderedAndProject" in plan
    # The files that hold only earlier rows have no value the pushed filter could pass.
    files = table.filter("project = 'p'").groupBy(F.input_file_name().alias("f")).agg(F.min("confidence").alias("low")).collect()
    assert sum(r.low > 0.25 for r in files) >= 2
    assert len(entities.list_page(table, "p", limit=0).collect()) == 1 and len(entities.list_page(table, "p", limit=10**6).collect()) == 200


def test_overview_in_one_exchange(some):
    got = {(r.project, r.entity_type, r.whole): (r.total, r.avg_confidence, r.high, r.medium, r.low) for r in entities.overview(some).collect()}
    rows = some.collect()
    for (p, t, whole), found in got.items():
        own = [r.confidence for r in rows if r.project == p and (whole or r.entity_type == t)]
        assert found[0] == found[4] == len(own) and found[2:4] == (sum(c >= 0.8 for c in own), sum(c >= 0.5 for c in own)) and abs(found[1] - sum(own) / len(own)) < 0.0051
    assert len(got) == 14 and str(entities.overview(some)._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1


def test_relation_ranges_are_the_pairs(some):
    pairs = entities.relations(some).filter("relation <> 'similar'")
    ranges = entities.relation_ranges(some)
    want = {(r.project, r.relation): r["count"] for r in pairs.groupBy("project", "relation").count().collect()}
    assert {(r.project, r.relation): r.n for r in ranges.groupBy("project", "relation").agg(F.sum("n").alias("n")).collect()} == want and ranges.count() <= some.count()
    full = entities.expanded(ranges, some)
    assert {tuple(r) for r in full.drop("description").collect()} == {tuple(r) for r in pairs.collect()}
    said = {(r.relation, r.description) for r in full.filter("source < 40 and target < 60").collect()}
    assert all(d == f"{d.split()[0]} {r.replace('_', ' ')} {d.split()[-1]}" for r, d in said) and len({r for r, _ in said}) == 3
    alike = entities.described(some.sparkSession.createDataFrame([("p", 1, 2, "similar")], "project string, source long, target long, relation string"), some.withColumn("project", F.lit("p"))).first()
    assert alike.description == "Similar entities: v1 and v2"


def test_cascade(spark):
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    frames = {
        "projects": f([("a",), ("b",), (None,)], "id string"),
        "crawl_jobs": f([("j1", "a"), ("j2", "b"), ("j3", None)], "id string, project_id string"),
        "crawled_pages": f([("g1", "j1"), ("g2", "j2"), (None, "j1"), ("g3", "j3")], "id string, crawl_job_id string"),
        "page_content_sections": f([("s1", "g1"), ("s2", "g2"), ("s3", None)], "id string, page_id string"),
        "entities": f([("e1", "a"), ("e2", "b"), ("e3", "b")], "id string, project_id string"),
        "entity_relations": f([("r1", "e1", "e2"), ("r2", "e2", "e1"), ("r3", "e2", "e3"), ("r4", None, "e3")], "id string, entity_id string, related_entity_id string"),
    }
    left = tables.delete_cascade(frames, "projects", f([("a",), (None,), ("zz",)], "id string"))
    assert {t: sorted(str(r[0]) for r in df.collect()) for t, df in left.items()} == {"projects": ["None", "b"], "crawl_jobs": ["j2", "j3"], "crawled_pages": ["g2", "g3"], "page_content_sections": ["s2", "s3"], "entities": ["e2", "e3"], "entity_relations": ["r3", "r4"]}
    assert {t for t, _, _ in tables.OWNED} <= set(tables.SCHEMAS) and all(c in tables.SCHEMAS[t] for t, c, _ in tables.OWNED)


def test_stream_in_any_cut_is_the_batch(spark, tmp_path):
    rng = random.Random(7)
    bits = ["Acme Software", "Globex Inc", "$5 per month", "Web Development", "Dashboard", "20% off", "nothing", "Secure"]
    rows = [(rng.choice("pq"), i, None, rng.choice(bits), None, " and ".join(rng.choices(bits, k=4)), [rng.choice(bits)]) for i in range(60)]
    pages = spark.createDataFrame(rows, stream.PAGES).withColumn("crawled_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(4000))))
    found = entities.extracted(pages.drop("crawled_at"))
    entity_store.upsert(spark, str(tmp_path / "batch"), found.select("project", "entity_type", "value", "confidence", "context", "ord"), "one")
    columns = ["project", "entity_type", "normalized_value", "value", "confidence", "context", "frequency"]
    read = lambda p: sorted((tuple(r) for r in entity_store.read(spark, str(tmp_path / p)).select(*columns).collect()), key=str)
    want = read("batch")
    for name, cut in (("three", F.pmod("page_id", F.lit(3))), ("late", F.when(F.col("page_id") < 50, 1).otherwise(0))):
        for n in [r[0] for r in pages.select(cut.alias("n")).distinct().collect()]:
            part = pages.filter(cut == n)
            # A page that comes twice within the delay counts once.
            part.unionByName(part.filter("page_id % 5 = 0")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in-{name}"))
        stream.start(spark, str(tmp_path / f"in-{name}"), str(tmp_path / name), str(tmp_path / f"cp-{name}"), files=1).awaitTermination()
        assert read(name) == want and len(want) > 8


def test_sql_functions(spark):
    sql.register(spark)
    texts = ["Über Software and Café Platform at $5 per month, 20% off", None, "", "Acme Inc. @acme Dashboard ſsl", "plain", " $7 "]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    docs.createOrReplaceTempView("docs_")
    got = {tuple(r) for r in spark.sql("SELECT id, e.* FROM docs_, LATERAL extract_entities(text, 'title', 0.5D) e").collect()}
    columns = ["id", "entity_type", "pattern", "start", "value", "confidence", "context"]
    assert got == {tuple(r) for r in entities.extract(docs, field="title").select(*columns).collect()} and len(got) > 8
    from pagequarry.functions import text

    values = spark.createDataFrame([(v, w) for v in ["The  Foo Inc.", "\tan Foo bar", "", None, "x co"] for w in ["foo bar", "", None]], "a string, b string")
    values.createOrReplaceTempView("values_")
    want = values.select(text.normalize_value("a"), text.similarity("a", "b")).collect()
    rows = spark.sql("SELECT normalize_value(a), value_similarity(a, b), strip_text(a), reading_minutes(a) FROM values_").collect()
    assert [r[0] for r in rows] == [r[0] for r in want] and [r[1] for r, w, v in zip(rows, want, values.collect(), strict=True) if " " not in (v.a or "")] == [w[1] for w, v in zip(want, values.collect(), strict=True) if " " not in (v.a or "")]


def test_columns_of_any_name(spark):
    """Columns named like results are replaced, those named like helpers pass through."""
    names = ["low", "hit", "span", "phrase", "one", "_clean", "_rule", "rn", "_best"]
    base = spark.createDataFrame([(1, "Acme Software at $5 and 20% off. Product management suite", *range(len(names) + 6))], "id int, text string, " + ", ".join(f"{n} int" for n in [*names, "entity_type", "confidence", "value", "rule", "start", "subtype"]))
    for made in (entities.extract(base), entities.ruled(base), entities.prices(base), entities.product_names(base), entities.named_products(base), entities.best_per_page(entities.extract(base), "id")):
        rows = made.collect()
        assert len({c.lower() for c in made.columns}) == len(made.columns) and all([r[n] for n in names] == list(range(len(names))) for r in rows)
    page = base.selectExpr("id as page_id", "text as title", "text as meta_description", "text as content_text", "array(text) as headings", "1 as one", "'x' as field")
    assert entities.from_pages(page, kinds=("price",)).groupBy("field").count().count() == 4
