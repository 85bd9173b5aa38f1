"""URL filters against a slow walk over the links, and the SQL over pages that do link to each other."""

import random
import re

import duckdb
from pyspark.sql import functions as F

from pagequarry.llm import url_filters
from pagequarry.llm.queries import ORACLE_SQL, op13_url_filters

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = re.search("[/?#]|$", rest).start()
    return lower(rest[:at]), re.match("[^?#]*", rest[at:])[0]


def slow_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def slow(pages):
    edges, allowed, blocked = set(), {}, {}
    for _, url, html in pages:
        h, p = parts(url)
        if h:
            v = slow_rule(h, p)[1]
            allowed[h] = allowed.get(h, 0) + (v == "allow")
            blocked[h] = blocked.get(h, 0) + (v == "block")
            for link in re.findall(r"""<a (?:[^<>]*[ ])?href=["']?([^"'<> ]*)""", html or "", re.I):
                dst = parts("x:" + link if link.startswith("//") else link)[0]
                if dst and dst != h:
                    edges.add((h, dst))
    hosts = {*allowed, *(x for e in edges for x in e)}
    mass = {}
    for kind, seeds, way in (("t", allowed, edges), ("d", blocked, {(b, a) for a, b in edges})):
        total = sum(seeds.values()) or 1
        seed = {h: seeds.get(h, 0) * 10**15 // total for h in hosts}
        degree, now = {}, dict(seed)
        for a, _ in way:
            degree[a] = degree.get(a, 0) + 1
        for _ in range(20):
            new = {h: seed[h] * 15 // 100 for h in hosts}
            for a, b in way:
                new[b] += now[a] * 85 // 100 // degree[a]
            now = new
        mass[kind] = now
    bad = {h for h in hosts if mass["d"][h] > mass["t"][h] and mass["d"][h] > 10**15 // (10 * len(hosts))}
    out = []
    for i, url, _ in pages:
        h, p = parts(url)
        r, v = slow_rule(h, p)
        out.append((i, h, p, r, v or ("block" if h in bad else "allow")))
    return sorted(out, key=str)


def web(n=400):
    rng = random.Random(5)
    tops = ["com", "net", "net", "net", "example.org", "info"]
    hosts = [f"{rng.choice(['', 'www.', 'm.'])}h{i}.{rng.choice(tops)}" for i in range(60)]
    pages = []
    for i in range(n):
        to = [rng.choice(hosts[:9] if rng.random() < 0.6 else hosts) for _ in range(rng.randrange(4))]
        links = "".join(rng.choice(['<a href="https://{}/x">', "<A class='b' HREF='//{}?q'>", '<a href="/{}">', '<a data-href="http://no.{}/">', "<a href=http://{}>", "<p href='http://no.{}'>"]).format(h) for h in to)
        pages.append((i, f"http{rng.choice(['', 's'])}://{rng.choice(hosts).replace('h1', 'H1')}/{rng.choice(['fr', 'de', 'en', 'es'])}/{rng.randrange(20)}{rng.choice(['', '?a://b', '#c'])}", f"<html>{links}</html>"))
    return [*pages, (n, None, None), (n + 1, "", ""), (n + 2, "no-scheme/fr/", "<a href='//h1.com'>"), (n + 3, "x://", "x"), (n + 4, "a://B.com?c", None), (n + 5, "://org/", None), (n + 6, "u://a\nb.org/\n/c", None), (None, "http://h1.com/fr/", None), pages[0], pages[0]]


def test_url_filters(spark, tmp_path):
    pages = web()
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in op13_url_filters(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == slow(pages)
    assert {(r[3] is None, r[4]) for r in got} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(c.execute(f"select page_id, host, path, rule, verdict from ({ORACLE_SQL['op13_url_filters']})").fetchall(), key=str) == got


def test_ranks_stay_whole(spark):
    """A hub that links to every host and is linked by all; the masses never exceed the whole."""
    edges = [("hub", f"h{i}") for i in range(300)] + [(f"h{i}", "hub") for i in range(300)]
    seeds = spark.createDataFrame([("hub", 5, 0), ("h1", 0, 10**9)], "host string, allowed long, blocked long")
    got = url_filters.ranks(spark.createDataFrame(edges, "src string, dst string"), seeds).agg(F.sum("trust"), F.sum("distrust"), F.count("*")).first()
    assert 0.9e15 < got[0] <= 10**15 and 0.9e15 < got[1] <= 10**15 and got[2] == 301


def test_edges(spark):
    schema = "page_id long, url string, html string"
    assert url_filters.judged(spark.createDataFrame([], schema)).count() == 0
    row = spark.createDataFrame([(1, "http://a.org/x", None)], schema).selectExpr("*", "1 as host", "2 as HOST_", "3 as bad_", "4 as kind", "5 as rule")
    got = url_filters.judged(row)
    assert got.columns == ["page_id", "url", "html", "HOST_", "bad_", "kind", "host", "path", "rule", "verdict"] and got.first()["rule"] == "org/"
    long = spark.createDataFrame([(1, "http://" + "a" * 200_000 + ".org/" + "b" * 200_000, "<a " * 50_000 + "href='//" + "c" * 100_000 + ".net'")], schema)
    assert url_filters.judged(long).first()["verdict"] == "allow"
