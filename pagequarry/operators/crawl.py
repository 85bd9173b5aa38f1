"""Crawling a stored link graph breadth first: one round of joins a level.

Addresses belong to a part by their host. What is stored, linked and already fetched is kept in folders by part, and a level
reads only the folders of the parts that its addresses are in. So a round costs what its hosts hold, not what all do.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.functions import urls
from pagequarry.operators.html import parse_pages
from pagequarry.sources.tables import settled, stored

#: A site's pages of one level are counted in so many parts first; a host's rows are written by so many tasks.
SLICES, TASKS = 64, 8
#: A part has about so many links; there are MOST_PARTS at most.
PART_ROWS, MOST_PARTS = 500_000, 4096
#: Rows of a level up to which its own addresses are broadcast, and bytes of one address.
BROADCAST_BYTES = 16_000_000


def link_graph(pages: DataFrame) -> DataFrame:
    """``(url, target)`` of the crawlable links of ``pages(url, html)``, each once, both normalised."""
    parsed = parse_pages(pages.select("url", "html")).select("url", F.explode("links.href").alias("href"))
    inside = parsed.withColumn("host", urls.part("url", 2)).filter(urls.crawlable("href", "host"))
    return inside.select(urls.normalize("url").alias("url"), urls.normalize("href").alias("target")).filter("url is not null").distinct()


def allowed(asked: DataFrame, robots: DataFrame) -> DataFrame:
    """``asked(url, ...)`` without what ``robots(host, prefix, allow, ord)`` refuses.

    A host's first rule, by ord, whose prefix starts the path decides; without one a page is allowed. Paths are
    unquoted and quoted again as prefixes are; an empty one is ``/``.
    """
    rules = robots.select(F.col("host").alias("_h"), "prefix", "allow", "ord")
    own = asked.select("url").distinct().select("url", urls.part("url", 2).alias("_own"), urls.robots_path("url").alias("_path"))
    hit = own.join(rules, (F.col("_own") == F.col("_h")) & F.startswith("_path", F.col("prefix")))
    refused = hit.groupBy("url").agg(F.min_by("allow", "ord").alias("allow")).filter(~F.col("allow")).select("url")
    return asked.join(refused, "url", "left_anti")


def _part(url: Column | str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lower(urls.part(url, 2))), F.lit(parts)).cast("int")


def _filed(df: DataFrame, name: str, parts: int) -> DataFrame:
    """``df(url, ...)`` in folders by the part of its host; a host's rows are written by several tasks."""
    rows = df.withColumns({"part": _part("url", parts), "slice": F.pmod(F.xxhash64("url"), F.lit(TASKS))})
    return stored(rows.repartition("part", "slice").drop("slice"), name, "part")


def _of(filed: DataFrame, addresses: DataFrame, parts: int) -> DataFrame:
    """The rows of ``filed`` in the parts of ``addresses(url)``; their list is bounded by the number of parts."""
    if parts == 1:
        return filed
    some = [r["part"] for r in addresses.select(_part("url", parts).alias("part")).distinct().collect()]
    return filed.filter(F.col("part").isin(some))


def crawl(have: DataFrame, edges: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, max_pages: int = 50, max_depth: int | None = None, queue: bool = False) -> DataFrame:
    """``(project, url, depth, status)`` of what a crawl from ``seeds(project, url)`` fetches.

    A page in ``have(url)`` is ``crawled`` and its links in ``edges(url, target)`` come next; another
    is ``failed``. A level is fetched in the order of its addresses, until a project has ``max_pages``
    crawled pages; failed ones do not count. It ends when nothing new is linked, or after
    ``max_depth`` levels if that is given. With ``queue`` addresses that were found but not taken up are rows too,
    ``queued``, with the depth they were first found at. Null addresses and repeated rows are passed over.
    """
    links = edges.select("url", "target").filter("url is not null and target is not null")
    parts = max(1, min(MOST_PARTS, links.count() // PART_ROWS))
    pages = _filed(have.select("url").filter("url is not null").distinct().withColumn("found", F.lit(True)), "pages", parts)
    links = _filed(links, "links", parts)
    new = settled(seeds.select("project", "url").filter("project is not null and url is not null").distinct())
    used = new.select("project").distinct().withColumn("used", F.lit(0).cast("long"))
    levels: list[DataFrame] = []
    waiting: list[DataFrame] = []
    for depth in count():
        if robots is not None:
            new = allowed(new, robots)
        asked = settled(new.join(_of(pages, new, parts).drop("part"), "url", "left").select("project", "url", F.coalesce("found", F.lit(False)).alias("ok")))
        if asked.isEmpty():
            break
        if max_depth is not None and depth > max_depth:
            waiting.append(asked.withColumn("depth", F.lit(depth)))
            break
        level = _filed(_within(asked, used, max_pages).withColumn("depth", F.lit(depth)), "level", parts)
        levels.append(level)
        if queue:
            waiting.append(asked.join(level.select("project", "url"), ["project", "url"], "left_anti").withColumn("depth", F.lit(depth)))
        used = settled(used.join(level.filter("ok").groupBy("project").agg(F.count("*").alias("more")), "project", "left").select("project", (F.col("used") + F.coalesce("more", F.lit(0))).alias("used")))
        on = level.filter("ok").select("project", "url")
        on = settled(on.join(_of(links, on, parts).drop("part"), "url").select("project", F.col("target").alias("url")).distinct())
        # What was fetched before meets the level's own addresses in the scan; only what it shares with them goes on.
        some = F.broadcast(on) if (on.agg(F.sum(F.octet_length("url") + 64)).first()[0] or 0) <= BROADCAST_BYTES else on
        before = reduce(DataFrame.unionByName, [_of(x, on, parts) for x in levels]).select("project", "url").join(some, ["project", "url"], "left_semi")
        new = settled(on.join(before, ["project", "url"], "left_anti"))
    status = F.when(F.col("ok"), "crawled").otherwise("failed")
    out = [x.select("project", "url", "depth", status.alias("status")) for x in levels]
    if queue and waiting:
        left = reduce(DataFrame.unionByName, waiting).groupBy("project", "url").agg(F.min("depth").alias("depth"))
        out.append(left.withColumn("status", F.lit("queued")))
    nothing = asked.select("project", "url", F.lit(0).alias("depth"), F.lit("").alias("status")).limit(0)
    return reduce(DataFrame.unionByName, out, nothing).select("project", "url", F.col("depth").cast("int").alias("depth"), "status")


def _within(asked: DataFrame, used: DataFrame, most: int) -> DataFrame:
    """The rows up to the last page that a project may still crawl; no window holds a whole level of a site."""
    asked = asked.join(used, "project").filter(F.col("used") < most).select("project", "url", "ok", (most - F.col("used")).alias("left"))
    # Only a project whose level has more pages than it may still crawl needs an order.
    sizes = asked.filter("ok").groupBy("project").agg(F.count("*").alias("n"))
    tight = asked.filter("ok").join(sizes, "project").filter("n > left")
    part = W.partitionBy("project", "slice").orderBy("url")
    first = tight.withColumn("slice", F.pmod(F.xxhash64("url"), F.lit(SLICES))).withColumn("rn", F.row_number().over(part)).filter("rn <= left")
    last = first.withColumn("rn", F.row_number().over(W.partitionBy("project").orderBy("url"))).filter("rn = left").select("project", F.col("url").alias("last"))
    return asked.join(last, "project", "left").filter("last is null or url <= last").select("project", "url", "ok")


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """``(host, prefix, allow, ord)`` of ``files(host, text)``, the robots.txt of hosts, that hold for ``agent``.

    The standard library reads a file; one without a text allows all.
    """

    def run(batches):
        for b in batches:
            rows = []
            for host, text in zip(b["host"], b["text"], strict=True):
                parser = RobotFileParser()
                parser.parse((text or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(agent)), parser.default_entry)
                rows += [(host, r.path, r.allowance, i) for i, r in enumerate(entry.rulelines if entry else [])]
            yield pd.DataFrame(rows, columns=["host", "prefix", "allow", "ord"])

    return files.select("host", "text").mapInPandas(run, "host string, prefix string, allow boolean, ord int")


def progress(rows: DataFrame) -> DataFrame:
    """Pages crawled and failed per project, and found in all: those crawled and those still queued."""
    n = lambda *states: F.count_if(F.col("status").isin(*states))
    return rows.groupBy("project").agg(n("crawled").alias("pages_crawled"), n("failed").alias("pages_failed"), n("crawled", "queued").alias("total_pages_found"))


def fetched(recorded: DataFrame, timeout: float = 30.0, attempts: int = 1) -> DataFrame:
    """``(url, ok, html, http_status_code, error_message, tried)``: what asking for each address of ``recorded`` comes to.

    ``recorded(url, attempt, status, seconds, html, error)`` are responses as they came; an address is asked ``attempts``
    times at most, by attempt, until one is good. One that took longer than ``timeout`` seconds is a
    ``timeout``; a status of 400 and more, or an error, is a failure. Of the failures the last one's message stands.
    Addresses are normalised; repeated attempts count once, the one of the least message first.
    """
    late = F.coalesce(F.col("seconds") > timeout, F.lit(False))
    error = F.when(late, "timeout").when(F.col("error").isNotNull(), F.col("error")).when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status")))
    rows = recorded.select(urls.normalize("url").alias("url"), "attempt", "status", "html", error.alias("error")).filter((F.col("attempt") <= attempts) & F.col("url").isNotNull())
    good, order = F.col("error").isNull(), F.struct("attempt", F.coalesce("error", F.lit("")))
    best = lambda c: F.coalesce(F.min_by(F.when(good, F.struct(c)), F.when(good, order)), F.max_by(F.when(~good, F.struct(c)), F.when(~good, order)))[c]
    found = rows.groupBy("url").agg(F.bool_or(good).alias("ok"), F.min_by(F.when(good, F.col("html")), F.when(good, order)).alias("html"), best("status").alias("http_status_code"), best("error").alias("error_message"), best("attempt").alias("tried"))
    return found.select("url", "ok", "html", F.col("http_status_code").cast("int").alias("http_status_code"), F.when(~F.col("ok"), F.col("error_message")).alias("error_message"), "tried")


def crawl_recorded(recorded: DataFrame, seeds: DataFrame, robots: DataFrame | None = None, max_pages: int = 50, delay: float = 1.0, timeout: float = 30.0, attempts: int = 1) -> DataFrame:
    """A crawl that fetches from ``recorded`` responses: ``(project, url, depth, status, html, http_status_code, error_message, tried, due)``.

    Fetching a page gives its links. ``due`` is when a page's turn comes, in seconds after its project's first, ``delay`` apart in the order
    of depth and address; queued addresses have none. Addresses without a response fail as ``not found``.
    """
    got = stored(fetched(recorded, timeout, attempts), "responses")
    good = got.filter("ok")
    rows = stored(crawl(good.select("url"), link_graph(good.select("url", "html")), seeds, robots, max_pages, queue=True), "crawled")
    full = rows.join(got.drop("ok"), "url", "left")
    error = F.when(F.col("status") == "failed", F.coalesce("error_message", F.lit("not found")))
    # A project's turns are at most its pages and failures; they are numbered by level and slice, so that no task orders a whole site.
    ordered = _turns(rows.filter("status <> 'queued'").select("project", "url", "depth"))
    out = full.withColumn("error_message", error).join(ordered, ["project", "url"], "left")
    return out.select("project", "url", "depth", "status", F.when(F.col("status") == "crawled", F.col("html")).alias("html"), F.when(F.col("status") != "queued", F.col("http_status_code")).alias("http_status_code"), "error_message", F.when(F.col("status") != "queued", F.col("tried")).alias("tried"), (F.col("turn") * delay).alias("due"))


def _turns(rows: DataFrame) -> DataFrame:
    """``(project, url, turn)`` from 0 by depth and address: rows are dealt by ranges, and the counts of the ranges before are added."""
    dealt = stored(rows.repartitionByRange("project", "depth", "url").withColumn("range", F.spark_partition_id()), "turns")
    counts = dealt.groupBy("project", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("project").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("project", "range").orderBy("depth", "url")) - 1
    return dealt.withColumn("inside", inside).join(counts.select("project", "range", before.alias("before")), ["project", "range"]).select("project", "url", (F.col("before") + F.col("inside")).alias("turn"))
