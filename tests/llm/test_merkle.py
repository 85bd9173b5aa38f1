"""The Merkle manifest against a tree built by hand."""

import hashlib
import random
import zlib

import pytest

from pagequarry.llm import merkle
from pagequarry.llm.queries import op12_merkle_manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_tree(hashes):
    """The root, and each leaf's path: (children before, children after) of each level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append((level[run:p], level[p + 1 : run + 8]))
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return level[0], paths


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, slow_leaf(r)))
        trees[g] = (own, *slow_tree([slow_leaf(r) for r in own]))
    root, above = slow_tree([trees[g][1] for g in langs])
    out = []
    for g, up in zip(langs, above, strict=True):
        own, sub, paths = trees[g]
        for r, path in zip(own, paths, strict=True):
            h, whole = slow_leaf(r), path + up
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                h = slow_leaf((*r[:4], r[4] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in whole:
                h = sha("".join([*a, h, *b]))
            out.append((r[0], slow_leaf(r), sub, root, sha("".join(x for a, b in whole for x in [*a, *b])), h, h == root))
    return sorted(out, key=str)


def run(spark, tmp_path, rows, schema="doc_id long, source string, lang string, n_chars long, text string"):
    spark.createDataFrame(rows, schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    return sorted((tuple(r) for r in op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_manifest(spark, tmp_path):
    rng = random.Random(1)
    sizes = {"a": 530, "é": 65, None: 9, "": 8, "z": 1, "ab": 64, "Z": 2, "p": 3, "q": 1, "r": 1}
    rows = [(None if i % 97 == 0 else rng.randrange(900), rng.choice(["s", None]), g, rng.choice([None, 5]), rng.choice([None, "", "ÀB c", "Abc " * i])) for g, n in sizes.items() for i in range(n)]
    rows += rows[:20]
    got = run(spark, tmp_path, rows)
    assert got == slow_manifest(rows) and 0 < sum(r[6] for r in got) < len(got)


@pytest.mark.parametrize("n", [1, 8, 9])
def test_one_group(spark, tmp_path, n):
    rows = [(i, "s", "x", 1, "T") for i in range(n)]
    assert run(spark, tmp_path, rows) == slow_manifest(rows)


def test_one_row_repeated(spark, tmp_path):
    rows = [(3, "s", "x", 1, "T")] * 700
    assert run(spark, tmp_path, rows) == slow_manifest(rows)


def test_edges(edge, empty, tmp_path, spark):
    assert merkle.manifest(empty).count() == 0
    clash = edge.selectExpr("*", "1 as h", "2 as g", "3 as idx", "4 as n", "5 as path", "6 as parent", "7 as at", "8 as name", "9 as tie", "10 as part", "11 as leaf")
    plain = {(r.doc_id, r.leaf, r.subroot, r.root) for r in merkle.manifest(edge).collect()}
    assert plain == {(r.doc_id, r.leaf, r.subroot, r.root) for r in merkle.manifest(clash).collect()} and len(plain) == 12
