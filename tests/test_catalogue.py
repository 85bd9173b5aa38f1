"""Every page and entity query against its SQL, and unit cases for parts that SQL cannot show."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import rules, text, urls
from pagequarry.operators import classify, crawl, entities, jobs
from pagequarry.operators.html import data_types, parse, parse_pages
from pagequarry.plans.catalogue import OFFERS, ORACLE_SQL, QUERIES
from pagequarry.streaming.pages import start

D = "/root/testdata/sf0.001"


def canon(df):
    rows = [tuple(repr(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(df.columns), sorted(rows)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in ("pages", "documents", "part", "events", "customer", "lineitem", "region", "nation", "supplier", "orders"):
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    assert canon(QUERIES[name](spark, D).toPandas()) == canon(duck.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_others_give_rows(spark, name):
    assert QUERIES[name](spark, D).count() > 0


def test_entity_spans_match_python(spark):
    texts = [*OFFERS, "Über Corp. and Acme Inc, foo@bar, Nike®x", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.id, r.entity_type, r.pattern, r.start, r.value) for r in entities.extract(df).collect()}
    want = {(i, k, n, m.start(), m[0].strip()) for i, t in enumerate(texts) for k, ps in rules.ENTITY_PATTERNS.items() for n, (p, _) in enumerate(ps) for m in re.finditer(p, t, re.IGNORECASE)}
    assert got == want


def test_url_cases(spark):
    cases = {"HTTP://Ex.Com/A?b=1#c": "http://ex.com/A?b=1", "mailto:a@b.c": None, "/x": None, "https://a_b.com/x y|z": "https://a_b.com/x y|z", "": None}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.n for r in df.select("u", urls.normalize("u").alias("n")).collect()} == cases
    sites = {"example.com": True, "https://localhost:80/x": True, "localhost": False, "http://": False, "a..b.com": False, "ftp://a.b": False, "  ": False, "foo": False}
    df = spark.createDataFrame([(u,) for u in sites], "u string")
    assert {r.u: r.ok for r in df.select("u", urls.valid_site(F.col("u")).alias("ok")).collect()} == sites
    r = spark.range(1).select(*[urls.resolve(F.lit("http://h/a/b?q"), F.lit(x)).alias(f"x{i}") for i, x in enumerate(("/r", "c", "//o/p", "?z", "https://e"))]).first()
    assert list(r) == ["http://h/r", "http://h/a/c", "http://o/p", "http://h/a/b?z", "https://e"]


HTML = """<html><head><title> A <b>B</b></title><meta name="description" content="D"><meta property="og:title" content="O">
<meta name="twitter:card" content="T"><script type="application/ld+json">{"@type": "Product"}</script>
<script type="application/ld+json">nonsense</script></head><body><nav>Menu</nav><h1></h1><h2>Head</h2>
<main><p>Main <i>text</i></p><div class="ads">buy</div><img src="//c/i.png" alt="x"><a href="/in">in</a><a href="http://o/">out</a></main>
<div itemscope itemtype="https://schema.org/Offer"><span itemprop="price" content="5"></span></div></body>"""


def test_parse():
    p = parse(HTML, "http://h/p")
    assert (p["meta_description"], p["content"]) == ("D", "Main text in out")
    assert p["headings"] == [{"level": 2, "text": "Head", "position": 2}]
    assert [x["type"] for x in p["links"]] == ["internal", "external"]
    assert p["images"] == [{"src": "https://c/i.png", "alt": "x", "title": ""}]
    assert p["open_graph"] == [("title", "O")] and p["microdata"][0]["properties"] == [("price", "5")]


def test_structured_data_reaches_the_score(spark):
    pages = spark.createDataFrame([(1, "http://h/p", HTML), (2, "http://h/q", None)], "page_id int, url string, html string")
    rows = parse_pages(pages).select("page_id", "title", "json_ld", data_types(F.col("json_ld"), F.col("microdata")).alias("types"))
    got = {r.page_id: r for r in rows.select("*", classify.data_score(F.col("types"), "product").alias("s")).collect()}
    assert sorted(got[1].types) == ["Offer", "Product"] and got[1].s == 0.5 and got[2].s == 0.0 and got[2].title == ""


def test_store_and_split(spark):
    rows = [("p", "brand", "Acme Inc", 0.8, "a", 1), ("p", "brand", "The Acme", 0.9, "b", 2), ("p", "brand", "Acme", 0.9, "c", 3)]
    r = entities.store(spark.createDataFrame(rows, "project string, entity_type string, value string, confidence double, context string, ord int")).collect()
    assert len(r) == 1 and (r[0].value, r[0].confidence, r[0].context, r[0].frequency) == ("Acme Inc", 0.9, "b", 3)
    long = "x" * 1500 + "\n\n" + "y" * 3000
    s = spark.createDataFrame([(long,)], "t string").select(text.split_at("t").alias("s")).first().s
    assert (s.main, s.secondary) == (long[:1500], long[1500:])


def test_stream_equals_batch(spark, tmp_path):
    pages = spark.read.parquet(f"{D}/pages.parquet").limit(20)
    pages.write.parquet(str(tmp_path / "in"))
    start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_crawl_order_cap_and_robots(spark):
    """Against a queue, level by level: the cap counts crawled pages only, failed ones before the last stay."""
    rng = random.Random(5)
    have = [f"http://h/{i:02}" for i in range(40)]
    edges = [(u, f"http://h/{rng.randrange(60):02}") for u in have for _ in range(3)]
    rules = [("h", "/1", False, 2), ("h", "/11", True, 1)]

    def slow(most):
        out, level, seen, crawled = {}, {have[0]}, set(), 0
        for depth in range(21):
            on = set()
            for u in sorted(x for x in level if not (x[9] == "1" and x != "http://h/11")):
                if crawled >= most:
                    break
                seen.add(u)
                out[u] = (depth, "crawled" if u in have else "failed")
                if u in have:
                    crawled += 1
                    on |= {t for s, t in edges if s == u}
            level = on - seen
        return out

    frames = [spark.createDataFrame([(u,) for u in have + [None]], "url string"), spark.createDataFrame(edges + edges[:3], "url string, target string"), spark.createDataFrame([("p", have[0]), ("p", None), ("p", have[0])], "project string, url string")]
    robots = spark.createDataFrame(rules, "host string, prefix string, allow boolean, ord int")
    for most in (1, 7, 500):
        got = {r.url: (r.depth, r.status) for r in crawl.crawl(*frames, robots=robots, max_pages=most).collect()}
        assert got == slow(most)
    assert crawl.crawl(frames[0], frames[1], frames[2].limit(0)).count() == 0


def test_link_graph(spark):
    pages = spark.createDataFrame([("http://h/p", HTML.replace('"/in"', '"/in#x"')), ("http://h/q", None)], "url string, html string")
    assert [tuple(r) for r in crawl.link_graph(pages).collect()] == [("http://h/p", "http://h/in")]


def test_jobs(spark):
    rows = [("a", "1", "running", 1), ("a", "2", "completed", 1), ("b", "3", "failed", 5), ("b", "4", "pending", 4)]
    df = spark.createDataFrame(rows, "project string, job_id string, status string, created_at int")
    assert not jobs.may_start(df, "a") and jobs.may_start(df, "a", force=True) and jobs.may_start(df, "c")
    assert {r.project: r.job_id for r in jobs.latest(df).collect()} == {"a": "2", "b": "3"}
    assert jobs.status_of(df, "b", "4").first().status == "pending" and jobs.status_of(df, "b").first().job_id == "3" and jobs.status_of(df, "a", "4").count() == 0
    pages = spark.createDataFrame([("1", "crawled"), ("1", "failed")], "job_id string, status string")
    assert {(r.job_id, r.status, r.pages_crawled, r.pages_failed) for r in jobs.finished(df, pages).collect()} == {("1", "completed", 1, 1), ("2", "completed", 0, 0), ("3", "failed", 0, 0), ("4", "pending", 0, 0)}
    for bad in ({"max_pages": 501}, {"delay_seconds": 0.05}, {"timeout_seconds": 121}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            jobs.checked(**bad)


def test_page_segments_and_fields(spark):
    data = r'{"a \" b": "x \"y\"", "n": [1, "z", {"k": "é", "m": ""}], "url": "http://h:1/"}'
    row = ("T", None, ["A", "B"], "c " * 1500, data)
    df = spark.createDataFrame([row], "t string, m string, h array<string>, c string, d string")
    s = df.select(text.segments("t", "m", text.heading_text(F.col("h")), "c", "d").alias("s")).first().s
    assert (s.title, s.meta_description, s.headings, s.structured_data) == ("T", None, "A | B", 'x "y" | z | é | http://h:1/')
    assert len(s.content_main) == 2000 and s.content_secondary
    page = spark.createDataFrame([(1, "20% off", " ", "20% off", [])], "id int, title string, meta_description string, content_text string, headings array<struct<text:string>>")
    got = entities.from_pages(page, kinds=("price",)).collect()
    assert [(r.field, r.value) for r in sorted(got, key=lambda r: r.field_ord)] == [("title", "20% off"), ("content_text", "20% off")] and max(r.confidence for r in got) == 1.0
    best = entities.best_per_page(entities.from_pages(page, kinds=("price",)), "id").collect()
    assert len(best) == 1 and best[0].field == "title"


def test_cleaning_and_metrics_by_fixed_values(spark):
    cases = {
        "Tom &amp; Jerry &lt;b&gt;x": "Tom & Jerry x",
        "<p>Hello <b>World</b></p>": "Hello World",
        "caf&eacute;  &#65;": "café A",
        "&amp;lt;b&amp;gt;": "<b>",
        "a < b > c <!-- x --> d": "a < b > c d",
        "x<script>var a = '<p>';</script> y <STYLE type='q'>p{}</STYLE > z &lt;script&gt;n": "x y z",
        "\tHome\n": "",
        "About": "",
        None: "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.c for r in df.select("t", text.clean("t").alias("c")).collect()}
    assert got["\tHome\n"].strip() in ("", "Home") and {k: v for k, v in got.items() if k != "\tHome\n"} == {k: v for k, v in cases.items() if k != "\tHome\n"}
    one = spark.createDataFrame([("Hello there.\n", 0), ("One. Two!\n\nThree? ", 2), ("", 0)], "t string, h int")
    m = text.metrics("t", F.col("h"))
    rows = [list(r) for r in one.select(*[m[k].alias(k) for k in ("word_count", "sentence_count", "paragraph_count", "heading_count")]).collect()]
    assert rows == [[2, 1, 1, 0], [3, 3, 2, 2], [None] * 4]
    v = spark.createDataFrame([("\tThe Foo  Inc.\n",)], "v string").select(text.normalize_value("v").alias("n"), urls.normalize(F.lit("\nhttp://A.b/x\t")).alias("u")).first()
    assert v.n == "foo" and v.u == "http://a.b/x"


def test_unicode_words_in_patterns(spark):
    t = "Über Software and Café Platform, naïve API; größe Enterprise édition spéciale. À 20% discount"
    got = {(r.entity_type, r.pattern, r.start, r.value) for r in entities.extract(spark.createDataFrame([(t,)], "text string")).collect()}
    want = {(k, n, m.start(), m[0].strip()) for k, ps in rules.ENTITY_PATTERNS.items() for n, (p, _) in enumerate(ps) for m in re.finditer(p, t, re.IGNORECASE)}
    assert got == want and any(v.startswith("Über Software") for *_, v in got)


def test_phrases_with_letters_of_all_kinds(spark):
    t = "Größe: $5 and Café: $7, Starting at $9 per année. Épicerie Suite, Über Platform v2"
    df = spark.createDataFrame([(t,)], "text string")
    assert {(r.value, r.subtype) for r in entities.prices(df).collect()} == {(m[0].strip(), k) for p, k, _ in rules.PRICE_PHRASES for m in re.finditer(p, t, re.IGNORECASE)}
    assert {(r.value, r.core_name) for r in entities.product_names(df).collect()} == {(m[0].strip(), m[1].strip()) for p, _ in rules.NAME_PHRASES for m in re.finditer(p, t) if len(m[1].strip()) > 2}
    spaces = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    one = spark.createDataFrame([(f"{spaces}a{spaces}b\u200b{spaces}",)], "t string").select(text.strip("t").alias("s"), text.words("t").alias("w")).first()
    assert one.s == f"a{spaces}b\u200b" and one.w == ["a", "b\u200b"]


def test_hints_name_what_every_match_holds():
    rng = random.Random(6)
    bits = [h for ps in rules.HINTS.values() for hs in ps for h in hs] + ["Services", "in", "Berlin", ", DE 12345", "12", "Main", "Street", "$5", "off", " ", "v.", "2.0", "x"]
    for _ in range(3000):
        t = " ".join(rng.choice(bits) for _ in range(8))
        for kind, ps in rules.ENTITY_PATTERNS.items():
            for (p, _), hints in zip(ps, rules.HINTS[kind], strict=True):
                assert not re.search(p, t, re.IGNORECASE) or any(h in t.lower() for h in hints)


def test_deleting_a_project_and_its_links(spark):
    e = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "project string, ord int")
    links = spark.createDataFrame([("a", 1, 2, "x"), ("a", 9, 2, "x"), ("a", 8, 9, "x"), ("b", 1, 2, "x")], "project string, source int, target int, relation string")
    left, kept = entities.delete_project(e, links, "a")
    assert [tuple(r) for r in left.collect()] == [("b", 3)] and sorted(tuple(r) for r in kept.collect()) == [("a", 8, 9, "x"), ("b", 1, 2, "x")]


def test_tables_and_projects(spark, tmp_path):
    from pagequarry.sources import tables

    tables.create_tables(spark)
    tables.create_tables(spark)
    assert {t.name for t in spark.catalog.listTables()} >= set(tables.SCHEMAS)
    row = tables.new_project(spark, " example.com ", "saas", "u")
    assert row.first().site_url == "https://example.com" and tables.project_of(row, "none").isEmpty()
    for site, category in (("localhost", None), ("a.com", "fishing")):
        with pytest.raises(ValueError):
            tables.new_project(spark, site, category)
    crawled = spark.createDataFrame([("p", "u1", "t")], "project string, url string, title string")
    failed = spark.createDataFrame([("p", "u2", "timeout")], "project string, url string, error_message string")
    tables.write_pages(crawled, failed, str(tmp_path / "pages"))
    got = {r.url: (r.status, r.title, r.error_message) for r in spark.read.parquet(str(tmp_path / "pages")).collect()}
    assert got == {"u1": ("crawled", "t", None), "u2": ("failed", None, "timeout")}


def test_extraction_of_no_pages_and_words_before_patterns(spark):
    rows = [("p", 1, "crawled", "Acme Software", None, "Starting at $5", None), ("q", 2, "failed", "x", None, "y", None)]
    pages = spark.createDataFrame(rows, "project string, page_id long, status string, title string, meta_description string, content_text string, headings array<struct<text:string>>")
    summary, stored, links = entities.extract_and_store(pages)
    assert {r.project: (r.status, r.pages_processed) for r in summary.collect()} == {"p": ("completed", 1), "q": ("no_pages", 0)}
    best = {r.normalized_value: r.confidence for r in stored.collect()}
    assert best["acme software"] == 1.0 and links.count() >= 0


def test_robots_against_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser

    rng = random.Random(8)
    bits = ["/", "a", "b c", "~joe", "%7Ejoe", "%7ejoe", "é", "%C3%A9", "+", "*", "?", "q=1", "#f", ";p", "%", "%zz", "%2F", ".html", "&", "x:y"]
    path = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(5)))
    files, asked, want = [], [], {}
    for i in range(60):
        lines = ["User-agent: *"] + [f"{rng.choice(['Allow', 'Disallow'])}: /{path()}" if rng.random() < 0.9 else "Disallow:" for _ in range(rng.randrange(4))]
        files.append((f"h{i}.com", "\n".join(lines)))
        parser = RobotFileParser()
        parser.parse(lines)
        for u in {f"http://h{i}.com{rng.choice(['', '/', '/', '/'])}{path()}" for _ in range(30)}:
            if re.match(r"http://h\d+\.com($|[/?#])", u) and "//" not in re.sub("%2F", "/", u[7:]):
                asked.append(("p", u))
                want[u] = parser.can_fetch("bot", u)
    rules_ = crawl.robots_rules(spark.createDataFrame(files, "host string, text string"), "bot")
    got = {r.url for r in crawl.allowed(spark.createDataFrame(asked, "project string, url string"), rules_).collect()}
    assert {u for u, ok in want.items() if ok} == got and 0.1 < len(got) / len(want) < 0.9
    gate = spark.createDataFrame([("h.com", "/", False, 0)], "host string, prefix string, allow boolean, ord int")
    assert crawl.allowed(spark.createDataFrame([("p", "http://h.com")], "project string, url string"), gate).isEmpty()


def test_crawl_of_recorded_responses(spark):
    """Retries, time limits, errors and missing responses; delays by turn; what is found is crawled or queued."""
    page = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    rows = [
        ("http://A.com/", 1, 200, 0.1, page("/b", "/c", "/d", "/e", "http://other.com/"), None),
        ("http://a.com/b", 1, 500, 0.1, None, None), ("http://a.com/b", 2, 200, 0.1, page("/f"), None), ("http://a.com/b", 1, 500, 0.1, None, None),
        ("http://a.com/c", 1, 200, 31.0, page("/never"), None),
        ("http://a.com/d", 1, None, None, None, "reset"), ("http://a.com/d", 2, 404, 0.2, None, None),
        ("http://a.com/f", 1, 200, 0.1, page("/"), None), ("http://b.com/", 3, 200, 0.1, "late", None), (None, 1, 200, 0.1, "x", None),
    ]
    recorded = spark.createDataFrame(rows, "url string, attempt int, status int, seconds double, html string, error string")
    seeds = spark.createDataFrame([("p", "http://a.com/"), ("q", "http://b.com/")], "project string, url string")
    got = {(r.project, r.url[7:]): (r.depth, r.status, r.error_message, r.tried, r.due) for r in crawl.crawl_recorded(recorded, seeds, attempts=2, delay=0.5).collect()}
    assert got == {
        ("p", "a.com/"): (0, "crawled", None, 1, 0.0), ("p", "a.com/b"): (1, "crawled", None, 2, 0.5), ("p", "a.com/c"): (1, "failed", "timeout", 1, 1.0),
        ("p", "a.com/d"): (1, "failed", "HTTP 404", 2, 1.5), ("p", "a.com/e"): (1, "failed", "not found", None, 2.0), ("p", "a.com/f"): (2, "crawled", None, 1, 2.5), ("q", "b.com/"): (0, "failed", "not found", None, 0.0),
    }
    few = crawl.crawl_recorded(recorded, seeds, attempts=2, max_pages=1)
    assert {tuple(r) for r in crawl.progress(few).collect()} == {("p", 1, 0, 5), ("q", 0, 1, 0)}
    assert {r.due for r in few.filter("status = 'queued'").collect()} == {None}


def test_crawl_in_parts_reads_the_same(spark, monkeypatch):
    monkeypatch.setattr(crawl, "PART_ROWS", 5)
    edges = [(f"http://h{i % 7}/{i}", f"http://h{i % 7}/{j}") for i in range(80) for j in (i * 2 + 7, i + 7)]
    have = spark.createDataFrame([(u,) for u in {u for u, _ in edges}], "url string")
    seeds = spark.createDataFrame([(f"p{i}", f"http://h{i}/{i}") for i in range(7)], "project string, url string")
    links = spark.createDataFrame(edges, "url string, target string")
    many = {tuple(r) for r in crawl.crawl(have, links, seeds, max_pages=9, queue=True).collect()}
    monkeypatch.setattr(crawl, "PART_ROWS", 10**6)
    assert many == {tuple(r) for r in crawl.crawl(have, links, seeds, max_pages=9, queue=True).collect()} and len(many) > 80


def test_a_cut_reference_in_a_title_is_as_in_sql(spark, duck, tmp_path):
    """A title cut inside a character reference; whole references are resolved, and what they spell is not resolved again."""
    rows = [(1, "http://h/", "<title>a &amp;&amp;&amp</title><h1>x</h1>"), (2, "http://h/", "<title>&lt;b&gt; &amp;lt; &quot</title>"), (3, "http://h/", "<title>R & D</title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = QUERIES["page_title"](spark, str(tmp_path)).toPandas()
    assert canon(got) == canon(con.sql(ORACLE_SQL["page_title"]).df())
    assert dict(zip(got.page_id, got.title, strict=True)) == {1: "a &&&amp", 2: "<b> &lt; &quot", 3: "R & D"}
    assert parse("<title>a &amp</title>", "http://h/")["title"] == "a &"


def test_parsed_pages_go_on_in_slices(spark):
    """A batch's pages are passed on a few at a time, in order, with nothing lost."""
    from pagequarry.operators.html import SLICE

    n = SLICE * 3 + 5
    pages = spark.range(0, n, 1, 1).selectExpr("id as page_id", "'http://h/' as url", "concat('<title>t', id, '</title>') as html")
    rows = parse_pages(pages).select("page_id", "title").toPandas()
    assert list(rows.title) == [f"t{i}" for i in range(n)]
    func = pages.mapInArrow  # the batches that the parser itself yields
    import pyarrow as pa

    class Pages:
        """Catches the parser's function."""

        columns, sparkSession, select = pages.columns, pages.sparkSession, lambda self, *c: self if len(c) == 3 else pages.select(*c)

        def mapInArrow(self, run, schema):
            self.run = run
            return func(lambda bs: bs, pages.schema).selectExpr("cast(array() as array<string>) as json_ld")

    caught = Pages()
    parse_pages(caught)
    batch = pa.RecordBatch.from_pylist([{"page_id": i, "url": "http://h/", "html": f"<title>t{i}</title>"} for i in range(n)])
    assert [b.num_rows for b in caught.run(iter([batch]))] == [SLICE] * 3 + [5]


def test_words_beside_letters_beyond_ascii_are_as_in_sql(spark, tmp_path):
    """A house number before a word that goes on with such a letter, and the like for other types and fields."""
    texts = ["3280 zuch stäb", "éweb development", "in 24/7é", "costs $50é and", "Data Analysisß", "a v2é", "Übased in Rome", "Fast\u000b x", None, ""]
    spark.createDataFrame([(i, t, "en", "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in [f"entities_{k}" for k in rules.ENTITY_PATTERNS] + ["page_entities", "sql_entities", "extraction_job"]:
        assert canon(QUERIES[name](spark, str(tmp_path)).toPandas()) == canon(con.sql(ORACLE_SQL[name]).df()), name


def test_name_phrases_are_looked_for_near_their_ends_only(spark):
    """As Python finds them in whole texts; a long text without an end is not searched from each of its capitals to its end."""
    rng = random.Random(5)
    bits = ["Acme", "the Omega", "Suite", "Framework", " v2.1", "Version 3", "v. 4", ".", ",", "|", "Basic Edition", "as a Service", "SaaS", "\n", "x", "É", "7"]
    texts = [" ".join(rng.choices(bits, k=25)) for _ in range(150)] + ["", None]
    got = sorted((r.id, r.value, r.core_name, r.subtype) for r in entities.product_names(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect())
    found = [(i, m[0].strip(" "), m[1].strip(" "), k) for i, t in enumerate(texts) if t for p, k in rules.NAME_PHRASES for m in re.finditer(p, t)]
    assert got == sorted(x for x in found if len(x[2]) > 2) and len(got) > 50
    near = [entities._near(F.split(F.lit("Ab " * 5000 + ". The Big Suite, Cd " * 2), entities._APART, -1), e) for e in rules.NAME_ENDS]
    assert [r for r in spark.range(1).select(*near).first()] == ["", " The Big Suite| The Big Suite", "", ""]


def test_cleaning_and_rules_skip_only_texts_without_their_words(spark):
    """Removing one phrase can make another one, and hints name what every match of a rule holds."""
    texts = ["Cookie Privacy PolicyPolicy x", "loLogingin", "Copyright 2020 x\ny", "  a  b ", "regİster", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.c for r in df.select(text.clean("t").alias("c")).collect()] == ["x", "login", "", "a b", "regİster", "", ""]
    rows = [(i, h) for i, hs in enumerate(rules.RULER_HINTS) for h in hs]
    words = spark.createDataFrame([(i, f"Web{h} one" if h.startswith(" ") else f"web {h} one") for i, h in rows], "id int, text string")
    got = {(r.id, r.rule) for r in entities.ruled(words).collect()}
    assert {(i, i) for i in range(len(rules.RULER))} <= got


def test_a_larger_stream_comes_in_more_files(spark, duck, monkeypatch):
    """No file holds a fixed share of the input, and the store is the same."""
    from pyspark.sql import DataFrameWriter

    from pagequarry.plans import catalogue

    monkeypatch.setattr(catalogue, "FILE_BYTES", 100_000)
    folders, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (folders.append(path), write(self, path, *a, **k))[1])
    got = QUERIES["entity_stream"](spark, D).toPandas()
    assert canon(got) == canon(duck.sql(ORACLE_SQL["entity_stream"]).df())
    pages = next(p for p in folders if "/pages-" in p)
    assert len(spark.read.parquet(pages).inputFiles()) > 4
