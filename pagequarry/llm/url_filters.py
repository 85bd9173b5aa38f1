"""URL filters by rules and, where no rule fits, by what flows over links between hosts; DataFrame functions only.

Pages that a rule allows make their host a seed of trust, pages that a rule blocks one of distrust. Trust
goes along links (personalised PageRank), distrust against them: who links to a blocked host is suspect.
Masses are whole numbers, so any order of adding gives the same ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut, unused

# Verdict, host and path of each rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The whole mass of a kind, the share in a hundred that goes on over links, and the most steps.
MASS, ON, STEPS = 10**15, 85, 20
#: A host is blocked if its distrust exceeds its trust and this part of the mean mass of a host.
PART = 10
#: Lists of up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16_000_000
LINK = r"""(?i)<a[ \t\r\n\f](?:[^<>]*[ \t\r\n\f"'])?href[ \t\r\n\f]*=[ \t\r\n\f]*["']?[ \t\r\n\f]*((?:[a-z][a-z0-9+.-]*:)?//[^"'<> \t\r\n\f]*)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct<rule,verdict>`` of the longest rule that fits, null if none does; of equally long ones that of the longer host, then ``block``.

    A rule fits its host and all of that's subdomains if the path starts with its path. The rules are a list in the
    program, so they become one expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    # The last one wrapped around the others is asked first.
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: each link from one host to another, once; links are absolute or begin with ``//``."""
    named = F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lambda x: host(F.when(x.startswith("//"), F.concat(F.lit("x:"), x)).otherwise(x)))
    found = pages.select(host(F.col("url").cast("string")).alias("src"), F.explode(F.array_distinct(named)).alias("dst"))
    return found.filter("src <> '' and dst <> '' and src <> dst").distinct()


def _small(df: DataFrame, *names: str) -> DataFrame:
    """``df``, to be broadcast if the measured size of its rows is within bounds."""
    size = df.agg(F.sum(sum(F.octet_length(n) for n in names) + 64)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def ranks(edges: DataFrame, seeds: DataFrame, steps: int = STEPS) -> DataFrame:
    """``(host, trust, distrust)`` of every host in ``edges(src, dst)`` or ``seeds(host, allowed, blocked)``.

    Each kind's seeds hold MASS in proportion to their pages. In a step ON in a hundred of a host's mass goes
    in equal parts to its neighbours, and a seed gets the rest of 100 of its share; a host without
    neighbours sends nothing, which leaves the ranks in the same proportions. Steps end when nothing changes.
    """
    ways = edges.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b")))).alias("w")).select("w.*")
    degree = ways.groupBy("kind", "a").agg(F.count("*").alias("degree"))
    ways = cut(ways.join(degree, ["kind", "a"]))
    given = seeds.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("n")), F.struct(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("n")))).alias("s")).select("s.*")
    total = {r["kind"]: r["n"] for r in given.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    whole = F.when(F.col("kind") == "trust", total.get("trust") or 1).otherwise(total.get("distrust") or 1)
    share = F.expr(f"cast(n as decimal(19,0)) * {MASS}BD").alias("m")
    seed = given.filter("n > 0").select("kind", "host", share, whole.alias("whole")).selectExpr("kind", "host", "m div whole as seed")
    nodes = ways.select("kind", F.col("a").alias("host")).unionByName(ways.select("kind", F.col("b").alias("host"))).unionByName(given.select("kind", "host")).distinct()
    now = cut(nodes.join(seed, ["kind", "host"], "left").select("kind", "host", F.coalesce("seed", F.lit(0)).alias("seed")).withColumns({"mass": F.col("seed"), "moved": F.lit(True)}))
    for _ in range(steps):
        sent = ways.join(_small(now.filter("mass > 0").select("kind", F.col("host").alias("a"), "mass"), "a"), ["kind", "a"])
        got = sent.groupBy("kind", F.col("b").alias("host")).agg(F.sum(F.expr(f"mass * {ON} div 100 div degree")).alias("got"))
        new = F.expr(f"seed * {100 - ON} div 100") + F.coalesce("got", F.lit(0))
        now = cut(now.join(got, ["kind", "host"], "left").select("kind", "host", "seed", new.alias("mass"), (new != F.col("mass")).alias("moved")))
        if now.filter("moved").isEmpty():
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("mass"))), F.lit(0)).alias(kind)
    return now.groupBy("host").agg(of("trust"), of("distrust"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of these names.

    The verdict is the rule's where one fits. Else a page is blocked if its host has more distrust than trust,
    and more than a PARTth of the mean mass of a host; hosts that nothing reaches, and pages
    without a host, are allowed. Null urls have an empty host and path; null ``html`` has no links. Repeated
    rows are judged alike and each counts as a page of its host. An empty table gives no rows.
    """
    url = F.col("url").cast("string")
    names = pages.select(host(url).alias("host"), path(url).alias("path"))
    ruled = names.filter("host <> ''").select("host", rule(F.col("host"), F.col("path"), rules)["verdict"].alias("v"))
    seeds = cut(ruled.groupBy("host").agg(F.count_if(F.col("v") == "allow").alias("allowed"), F.count_if(F.col("v") == "block").alias("blocked")))
    found = cut(ranks(host_edges(pages), seeds))
    hosts = found.count()
    bad = found.filter((F.col("distrust") > F.col("trust")) & (F.col("distrust") > MASS // (PART * max(1, hosts)))).select("host")
    base = pages.drop("host", "path", "rule", "verdict")
    h, p, r, b = unused(base, "host_", "path_", "rule_", "bad_")
    bad = _small(cut(bad.select(F.col("host").alias(b))), b)
    out = base.withColumns({h: host(url), p: path(url)})
    out = out.withColumn(r, rule(F.col(h), F.col(p), rules)).join(bad, F.col(h) == F.col(b), "left")
    verdict = F.coalesce(F.col(r)["verdict"], F.when(F.col(b).isNotNull(), "block").otherwise("allow"))
    return out.select(*[F.col(f"`{c}`") for c in base.columns], F.col(h).alias("host"), F.col(p).alias("path"), F.col(r)["rule"].alias("rule"), verdict.alias("verdict"))
