"""Line dedup by all pairs of lines at edit similarity 0.8 or more, with no candidate rule but an exact one."""

import re
import zlib
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd

BINS = 4096


def form(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def similar_pairs(lines):
    """Indexes of the pairs. An edit changes three trigrams at most, so pairs that share too few are left out."""
    size = np.array([len(x) for x in lines])
    has = np.zeros((len(lines), BINS), np.float32)
    for i, x in enumerate(lines):
        has[i, list({zlib.crc32(x[j : j + 3].encode()) % BINS for j in range(max(1, len(x) - 2))})] = 1
    n, longer = has.sum(1), np.maximum(size[:, None], size[None, :])
    near = (np.minimum(size[:, None], size[None, :]) >= 0.8 * longer - 1e-9) & (has @ has.T >= np.maximum(n[:, None], n[None, :]) - 3 * np.floor(0.2 * longer + 1e-9))
    i, j = np.nonzero(np.triu(near, 1))
    pairs, texts = pd.DataFrame({"i": i, "j": j}), pd.DataFrame({"k": range(len(lines)), "l": lines})  # noqa: F841
    return duckdb.sql("select i, j from pairs join texts a on i = a.k join texts b on j = b.k where levenshtein(a.l, b.l) <= 0.2 * greatest(length(a.l), length(b.l)) + 1e-9").fetchall()


def exact_lines(docs):
    """Each document's text without later lines of a group."""
    seen = [(d, p, form(x)) for d, t in docs for p, x in enumerate((t or "").split("\n"))]
    lines = sorted({n for *_, n in seen if n})
    of = {n: i for i, n in enumerate(lines)}
    parent = list(range(len(lines)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in similar_pairs(lines):
        parent[find(i)] = find(j)
    first = {}
    for d, p, n in sorted(x for x in seen if x[2]):
        first.setdefault(find(of[n]), (d, p))
    gone = {(d, p) for d, p, n in seen if n and first[find(of[n])] != (d, p)}
    return {d: None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, p) not in gone) for d, t in docs}


def lost(before, after):
    """The positions of the lines of ``before`` that ``after`` lacks."""
    a, b = (before or "").split("\n"), (after or "").split("\n")
    kept = {x + i for x, _, n in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for i in range(n)}
    return [p for p in range(len(a)) if p not in kept]
