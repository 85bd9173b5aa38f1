"""A Merkle manifest of a table: a hash tree for each group of rows, and one over the groups' roots.

Levels are built by windows over eight nodes at most: an ordered list of a parent's children gives the parent's
hash and each child's siblings. Proofs come down the tree by joins on the parent, so nothing ever
meets by group alone, and a group of any size is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut, stage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<pos:int,siblings:array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """The hash of a row's values, each written as its UTF-8 byte count, a colon and itself, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in texts]))


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)


def is_tampered(doc_id: Column) -> Column:
    """Whether 3 divides the unsigned CRC-32 of the decimal doc_id; not for a null one."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 0, F.lit(False))


def _ranked(items: DataFrame, order: str) -> DataFrame:
    """``items(g, ...)`` with each one's ``idx`` in its group by ``order`` and then hash, and the group's size ``n``.

    Rows are dealt by ranges of group and order; a range's rows are counted, and the counts of those before are
    added to the places within it. Equal rows can be in several ranges.
    """
    own = stage(items.withColumn("tie", F.monotonically_increasing_id()), "items")
    dealt = stage(own.repartitionByRange("g", order, "h", F.xxhash64("tie")).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("g", "part").agg(F.count("*").alias("c"))
    # One row a group and range: their number is bounded by that of the groups plus that of the ranges.
    before = W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("g", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(W.partitionBy("g")).alias("n"))
    inside = F.row_number().over(W.partitionBy("g", "part").orderBy(order, "h", F.xxhash64("tie"))) - 1
    return dealt.withColumn("inside", inside).join(counts, ["g", "part"]).withColumn("idx", F.col("before") + F.col("inside")).drop("part", "tie", "inside", "before")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The levels of the trees over ``nodes(g, idx, h, n, ...)``, and for each level the roots ``(g, h)`` that are reached there.

    A level is its nodes with ``parent``, ``pos`` and ``siblings``; nodes that are alone are roots and in no level.
    """
    levels, roots = [], []
    nodes = cut(nodes)
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        roots.append(nodes.filter("n = 1"))
        if most <= 1:
            return levels, roots
        run = W.partitionBy("g", "parent").orderBy("idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        level = nodes.filter("n > 1").withColumns({"parent": F.floor(F.col("idx") / FANOUT), "pos": F.pmod("idx", F.lit(FANOUT)).cast("int")})
        level = level.withColumn("hs", F.collect_list("h").over(run))
        level = level.withColumns({"siblings": F.concat(F.slice("hs", F.lit(1), F.col("pos")), F.slice("hs", F.col("pos") + 2, F.lit(FANOUT))), "up": digest(F.array_join("hs", ""))})
        level = cut(level.drop("hs"))
        levels.append(level)
        above = level.select("g", F.col("parent").alias("idx"), F.col("up").alias("h"), F.ceil(F.col("n") / FANOUT).alias("n"))
        nodes, most = cut(above.distinct()), -(-most // FANOUT)


def _descend(levels: list[DataFrame], tops: list[DataFrame], keep: list[str]) -> DataFrame:
    """The lowest nodes' ``keep`` columns with ``path``, their siblings level by level, and ``top``.

    ``tops[k]`` are the roots reached at level k, with the ``path`` above them and what is theirs as ``top``.
    """
    below = None
    for k in reversed(range(len(levels) + 1)):
        own = keep if k == 0 else ["g", "idx"]
        ends = tops[k].select(*own, "path", "top")
        if k == len(levels):
            below = ends
        else:
            up = below.select("g", F.col("idx").alias("parent"), F.col("path").alias("above"), "top")
            step = F.array(F.struct("pos", "siblings")).cast(PATH)
            below = levels[k].join(up, ["g", "parent"]).select(*own, F.concat(step, "above").alias("path"), "top").unionByName(ends)
    return below


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path lead to."""
    step = lambda h, p: digest(F.concat(F.array_join(F.slice(p["siblings"], F.lit(1), p["pos"]), ""), h, F.array_join(F.slice(p["siblings"], p["pos"] + 1, F.lit(FANOUT)), "")))
    return F.aggregate(path, start, step)


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """``(doc_id, leaf, altered, subroot, root, path)``, one row per input row; doc_id is the ``order`` column.

    ``leaf`` is the hash of ``fields``. In each group leaves ascend by ``order`` (null first; ties by
    leaf), and while several nodes remain every FANOUT consecutive ones, the last run of fewer, become
    the hash of their hashes. What remains is ``subroot``; the subroots, by group (null first, UTF-8
    bytewise), give ``root`` in the same way. ``path`` holds for each level up to the root the leaf's
    place in its run and its siblings' hashes. ``altered`` is the leaf of the row with A-Z of its text
    in lower case where ``is_tampered``, else the leaf. A lone row is its own subroot, a lone group's
    subroot the root. Repeated rows are leaves of their own. An empty table gives no rows; other columns are ignored.
    """
    values = [F.col(f"`{f}`") for f in fields]
    other = [folded(v.cast("string")) if f == text else v for f, v in zip(fields, values, strict=True)]
    changed = F.when(is_tampered(F.col(f"`{order}`")), leaf(*other))
    g = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{order}`").alias("doc_id"), g.alias("g"), leaf(*values).alias("h"), changed.alias("altered"))
    levels, ends = _climb(_ranked(rows, "doc_id"))
    subs = reduce(DataFrame.unionByName, [e.select("g", "idx", "h").withColumn("at", F.lit(k)) for k, e in enumerate(ends)])
    if subs.isEmpty():
        return rows.select("doc_id", F.col("h").alias("leaf"), "altered", F.col("h").alias("subroot"), F.col("h").alias("root"), F.array().cast(PATH).alias("path"))
    # The tree over the subroots: one group, in the order of the groups' names.
    over = _ranked(subs.select(F.lit("").alias("g"), F.col("g").alias("name"), "h", "at"), "name")
    upper, tips = _climb(over)
    root = reduce(DataFrame.unionByName, [t.select("h") for t in tips]).first()[0]
    empty = [t.withColumns({"path": F.array().cast(PATH), "top": F.lit(root)}) for t in tips]
    named = cut(_descend(upper, empty, ["name", "h", "at"]).select(F.col("name").alias("g"), "path", F.col("h").alias("top"), "at"))
    tops = [e.join(named.filter(F.col("at") == k).drop("at"), "g") for k, e in enumerate(ends)]
    down = _descend(levels, tops, ["doc_id", "h", "altered"])
    return down.select("doc_id", F.col("h").alias("leaf"), F.coalesce("altered", "h").alias("altered"), F.col("top").alias("subroot"), F.lit(root).alias("root"), "path")


def proof(path: Column) -> Column:
    """The hash of a path's siblings, level by level."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda p: p["siblings"])), ""))
