"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for every end of ``edges(src, dst)``; component is the smallest node.

    Each round is grouping and joining only, a hub's rows are pre-aggregated before the shuffle,
    and lineage is cut by a checkpoint. Links with a null end and self-links are ignored; repeated
    and mirrored links count once; no links give no rows.
    """
    links = cut(
        edges.filter("src <> dst")
        .select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        links = cut(_small_star(_large_star(links)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _large_star(links: DataFrame) -> DataFrame:
    """Tie each node's larger neighbours to its smallest one."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie each node and its smaller neighbours to the smallest of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    return (
        links.join(least, "a")
        .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .filter("a <> b")
        .distinct()
    )
