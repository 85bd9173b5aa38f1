"""Reading the tables, writing crawled pages, and settling intermediate rows."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark DDL of the tables that crawling and extraction keep.
SCHEMAS = {
    "users": "id string, email string, auth_token string, created_at timestamp",
    "projects": "id string, user_id string, site_url string, business_category string, created_at timestamp",
    "crawl_jobs": "id string, project_id string, status string, base_url string, pages_crawled int, pages_failed int, total_pages_found int, started_at timestamp, completed_at timestamp, created_at timestamp, max_pages int, delay_seconds double, timeout_seconds int, respect_robots boolean, error_message string",
    "crawled_pages": "id string, crawl_job_id string, project_id string, url string, normalized_url string, title string, meta_description string, meta_keywords string, page_type string, confidence_score double, status string, crawled_at timestamp, content_text string, headings array<struct<level:int,text:string,position:int>>, images array<struct<src:string,alt:string,title:string>>, links array<struct<href:string,text:string,title:string,type:string>>, json_ld array<string>, microdata array<struct<type:string,properties:map<string,string>>>, open_graph map<string,string>, twitter_card map<string,string>, content_metrics struct<word_count:int,character_count:int,sentence_count:int,paragraph_count:int,heading_count:int,avg_words_per_sentence:double,reading_time_minutes:double>, error_message string, http_status_code int, extraction_method string, extraction_time_ms int, created_at timestamp, updated_at timestamp",
    "page_content_sections": "id string, page_id string, section_type string, section_order int, parent_section_id string, content_text string, content_html string, heading_level int, word_count int, character_count int, attributes string, created_at timestamp",
    "entities": "id string, project_id string, page_id string, entity_type string, value string, normalized_value string, confidence_score double, frequency int, context string, extraction_method string, created_at timestamp, updated_at timestamp",
    "entity_relations": "id string, entity_id string, related_entity_id string, relation_type string, confidence double, description string, created_at timestamp",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def create_tables(spark: SparkSession) -> None:
    """Create the tables of SCHEMAS in the warehouse, where they do not exist."""
    for name, columns in SCHEMAS.items():
        spark.sql(f"create table if not exists {name} ({columns}) using parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate rows that spark.checkpoint.dir names; only a local session without that setting (tests) gets one of its own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named and context.getCheckpointDir() is None and context.master.split("[")[0] != "local":
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="pagequarry-"))
    return named or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df``'s rows, computed once, from a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``df``'s rows, computed once, as Parquet in the shared folder, in folders by the columns ``by`` where given."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_pages(crawled: DataFrame, failed: DataFrame, path: str) -> None:
    """Crawled and failed pages in one table with their ``status``, a folder for each project; what failed ones lack is null."""
    both = crawled.withColumn("status", F.lit("crawled")).unionByName(failed.withColumn("status", F.lit("failed")), allowMissingColumns=True)
    both.write.mode("append").partitionBy("project").parquet(path)


#: What goes with a row: a table, its column, and the table of whose ``id`` that is. Parents come first.
OWNED = [
    ("crawl_jobs", "project_id", "projects"),
    ("crawled_pages", "crawl_job_id", "crawl_jobs"),
    ("page_content_sections", "page_id", "crawled_pages"),
    ("entities", "project_id", "projects"),
    ("entity_relations", "entity_id", "entities"),
    ("entity_relations", "related_entity_id", "entities"),
]


def delete_cascade(frames: dict[str, DataFrame], root: str, gone: DataFrame, owned: list[tuple[str, str, str]] = OWNED, ids: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """What is left of each table when the rows ``gone(id)`` of ``root`` go, and with them all that belong to them.

    ``owned`` lists each table's parents, a table after its parents; ``ids`` names key columns other than ``id``. A table's doomed keys come
    from its parents' by semi joins, and what is left by anti joins. Rows that belong to nothing stay; null keys belong to nothing.
    """
    ids = ids or {}
    key = lambda t: ids.get(t, "id")
    doomed = {root: settled(gone.select(F.col(gone.columns[0]).alias("k")).filter("k is not null").distinct())}
    left = dict(frames)
    left[root] = frames[root].join(doomed[root], F.col(key(root)) == F.col("k"), "left_anti")
    for table_ in dict.fromkeys(t for t, _, _ in owned):
        ends = [(c, doomed[p]) for t, c, p in owned if t == table_ and p in doomed]
        for column, keys in ends:
            left[table_] = left[table_].join(keys, F.col(column) == F.col("k"), "left_anti")
        if ends and any(p == table_ for _, _, p in owned):
            own = [frames[table_].join(keys, F.col(column) == F.col("k"), "left_semi").select(F.col(key(table_)).alias("k")) for column, keys in ends]
            doomed[table_] = settled(reduce(DataFrame.unionByName, own).filter("k is not null").distinct())
    return left


def content_list(pages: DataFrame, project: str, page_type: str | None = None, limit: int = 50, offset: int = 0) -> tuple[int, DataFrame]:
    """How many crawled pages a project has of a type, or in all, and one page of their list, the newest first, ties by id."""
    own = pages.filter((F.col("project") == project) & (F.col("status") == "crawled"))
    own = own if page_type is None else own.filter(F.col("page_type") == page_type)
    return own.count(), own.orderBy(F.desc("crawled_at"), "id").offset(offset).limit(limit)


def pages_by_type(pages: DataFrame) -> DataFrame:
    """Crawled pages per project and type; those without a type count as unknown."""
    done = pages.filter(F.col("status") == "crawled")
    return done.groupBy("project", F.coalesce("page_type", F.lit("unknown")).alias("page_type")).agg(F.count("*").alias("n"))


def new_project(spark: SparkSession, site_url: str, category: str | None = None, user_id: str | None = None) -> DataFrame:
    """A row for ``projects``; ``ValueError`` says why the address or the category is refused."""
    from pagequarry.functions.text import category_ok
    from pagequarry.functions.urls import site

    given = spark.createDataFrame([(site_url, category, user_id)], "site_url string, business_category string, user_id string")
    row = given.select(F.expr("uuid()").alias("id"), "user_id", site("site_url").alias("s"), "business_category", F.current_timestamp().alias("created_at"), category_ok("business_category").alias("ok"))
    error = row.select("s.error", "ok").first()
    if error["error"] or not error["ok"]:
        raise ValueError(error["error"] or "Invalid business category")
    return row.select("id", "user_id", F.col("s.url").alias("site_url"), "business_category", "created_at")


def project_of(projects: DataFrame, id: str, user_id: str | None = None) -> DataFrame:
    """The project of that id, if it is the user's where one is given."""
    own = projects.filter(F.col("id") == id)
    return own if user_id is None else own.filter(F.col("user_id") == user_id)
