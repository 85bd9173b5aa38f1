"""Substring dedup: words inside a 50-word window that an earlier document also has are removed.

1. Every window is keyed by the smallest hash among its short phrases, so equal windows have equal
   keys. Keys that occur in one text only rule their windows out; the others' windows are counted by
   a 128-bit hash, pre-aggregated before the shuffle. A window of two or more documents belongs to
   the first; a document's neighbouring windows of that kind form a confirmed passage.
2. Passages are cut into 25-word phrases, dealt to buckets by key, and compiled into one Aho-Corasick
   automaton a bucket. Stretches of documents with the same keys stream through it. Every window
   holds a whole phrase of its passage, so each occurrence is found; matching words on both sides
   decide how far it reaches.

Keys shared by very many documents are dealt to more buckets, each with a copy of their passages, so
that no bucket grows with a key. Exact copies of a text are settled by its hash and not matched.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut, stage

HOT = 1000
WINDOW, PHRASE, SEED_PHRASE = 50, 25, 8
SHARE, BUCKET = 256, 3000
_BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return (text or "").encode().split()


def _word_hashes(ws: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in ws), np.uint64, len(ws))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def _rolling(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive word hashes: a polynomial modulo 2^64, by Horner's rule."""
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(base) + h[i : i + len(out)]
    return _mix(out)


def runs(ws: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first windows and lengths of the runs of windows with one key."""
    if len(ws) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    phrase = min(SEED_PHRASE, window)
    grams = _rolling(_word_hashes(ws, 1), phrase, _BASE[0])
    key = sliding_window_view(grams, window - phrase + 1).min(axis=1)
    start = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
    return key[start].view(np.int64), start, np.diff(np.append(start, len(key)))


def window_hashes(ws: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each window."""
    return tuple(_rolling(_word_hashes(ws, s + 2), window, b).view(np.int64) for s, b in enumerate(_BASE))


def _run_table(docs: DataFrame, window: int) -> DataFrame:
    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = [runs(words(t), window) for t in b.column("text").to_pylist()]
                n = [len(o[0]) for o in out]
                take = pa.array(np.repeat(np.arange(b.num_rows), n))
                cols = [np.concatenate([o[i] for o in out]).astype(np.int64) for i in range(3)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_id").take(take), *(pa.array(c) for c in cols)], ["doc_id", "text_id", "key", "start", "n"])

    return docs.mapInArrow(make, "doc_id long, text_id long, key long, start long, n long")


def _windows(cand: DataFrame, window: int) -> DataFrame:
    """``(h1, h2, doc_id, pos)`` of the windows in each candidate document's runs."""

    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                parts = []
                for doc, text, rs in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                    h1, h2 = window_hashes(words(text), window)
                    pos = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in rs]))
                    parts.append((h1[pos], h2[pos], np.full(len(pos), doc, np.int64), pos.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["h1", "h2", "doc_id", "pos"])

    return cand.mapInArrow(make, "h1 long, h2 long, doc_id long, pos long")


_ROW = "bucket long, kind int, doc_id long, start long, body binary"


def _deal(cand: DataFrame, buckets: int, window: int) -> DataFrame:
    """Passages (kind 0) and stretches to search (kind 1), dealt to buckets by key."""

    def bucket(key: int, j: int) -> int:
        return xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True) + j.to_bytes(8, "little")) % buckets

    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                out = []
                for doc, text, rs, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "runs", "own")), strict=True):
                    ws, own = words(text), np.array(sorted(own or ()), np.int64)
                    for r in rs:
                        shares, lo, hi = -(-r["docs"] // SHARE), r["start"], r["start"] + r["n"]
                        mine = own[np.searchsorted(own, lo) : np.searchsorted(own, hi)]
                        for piece in np.split(mine, np.flatnonzero(np.diff(mine) > 1) + 1) if len(mine) else ():
                            body = b" ".join(ws[piece[0] : piece[-1] + window])
                            out += [(bucket(r["key"], j), 0, doc, int(piece[0]), body) for j in range(shares)]
                        if len(mine) < r["n"]:
                            out.append((bucket(r["key"], doc % shares), 1, doc, lo, b" ".join(ws[lo : hi + window - 1])))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "kind", "doc_id", "start", "body"])

    return cand.mapInArrow(make, _ROW)


def occurrences(passages: list[tuple[int, bytes]], stretches: list[tuple[int, int, bytes]], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """``(doc, from word, to word)`` where a stretch repeats a window of an earlier document's passage.

    ``passages`` are (doc, words joined by spaces), ``stretches`` (doc, number of the first word, words).
    """
    phrase = max(1, window // 2)
    number: dict[bytes, int] = {}
    texts, where = [], {}
    for p, (_, body) in enumerate(passages):
        ids = tuple(number.setdefault(w, len(number) + 1) for w in body.split())
        texts.append(ids)
        for at in range(0, len(ids) - phrase + 1, phrase):
            where.setdefault(ids[at : at + phrase], []).append((p, at))
    if not where:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for ids, places in where.items():
        automaton.add_word(ids, places)
    automaton.make_automaton()
    out = []
    for doc, start, body in stretches:
        ids = tuple(number.get(w, 0) for w in body.split())
        reach: dict[tuple[int, int], int] = {}
        for last, places in automaton.iter(ids):
            first = last - phrase + 1
            for p, at in places:
                line = (p, first - at)
                if passages[p][0] >= doc or reach.get(line, -1) > last:
                    continue
                text, a, z = texts[p], first, last + 1
                shift = first - at
                while a > 0 and a - shift > 0 and ids[a - 1] == text[a - 1 - shift]:
                    a -= 1
                while z < len(ids) and z - shift < len(text) and ids[z] == text[z - shift]:
                    z += 1
                reach[line] = z
                if z - a >= window:
                    out.append((doc, start + a, start + z))
    return sorted(set(out))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, spans array<struct<a,z>>)``: word ranges to remove, of documents whose text no smaller doc_id has."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    table = stage(_run_table(base.withColumn("text_id", F.xxhash64("text")), window), "runs")
    shared = table.groupBy("key").agg(F.min("text_id").alias("a"), F.max("text_id").alias("z"), F.count("*").alias("docs")).filter("a <> z").select("key", "docs")
    firsts = table.groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))
    # Of the copies of a text, only the first has its windows counted and searched.
    kept = table.join(firsts, ["text_id", "doc_id"], "left_semi").join(shared, "key")
    by_doc = kept.groupBy("doc_id").agg(F.collect_set(F.struct("key", "docs", "start", "n")).alias("runs"))
    cand = stage(by_doc.join(base, "doc_id"), "candidates")
    firsts_of = (
        _windows(cand, window)
        .groupBy("h1", "h2")
        .agg(F.min(F.struct("doc_id", "pos")).alias("f"), F.max("doc_id").alias("last"))
        .filter("f.doc_id < last")
        .groupBy("f.doc_id")
        .agg(F.collect_list("f.pos").alias("own"))
    )
    n = cand.agg(F.sum(F.size("runs"))).first()[0] or 0
    dealt = _deal(cand.join(firsts_of, "doc_id", "left"), max(1, -(-n // BUCKET)), window)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"] == 0
        passages = sorted(set(zip(pdf["doc_id"][kind], pdf["body"][kind], strict=True)))
        rest = pdf[~kind]
        found = occurrences(passages, list(zip(rest["doc_id"], rest["start"], rest["body"], strict=True)), window)
        return pd.DataFrame(found, columns=["doc_id", "a", "z"])

    found = dealt.groupBy("bucket").applyInPandas(search, "doc_id long, a long, z long")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("a", "z")).alias("spans"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept binary)``: each document's remaining words joined by spaces.

    A null or wordless text has no words. Repeated rows with one doc_id do not count against each
    other and give repeated rows; rows with a null doc_id lose nothing and cost others nothing. Other
    columns are ignored; an empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = cut(repeated_spans(base, window))
    marks = cut(base.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_id"), F.sha2("text", 256).alias("sha")))
    same = ["text_id", "sha"]
    firsts = cut(marks.groupBy(*same).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    # Fewer than HOT texts have more than one in HOT of all rows; their copies are not brought together.
    hot = firsts.filter(F.col("n") > marks.count() / HOT)
    cold = firsts.join(F.broadcast(hot), same, "left_anti")
    both = marks.join(F.broadcast(hot), same).unionByName(marks.join(F.broadcast(hot), same, "left_anti").join(cold, same))
    copies = both.filter("doc_id > first").select("doc_id", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(-1).cast("long").alias("z"))).alias("spans"))
    removed = spans.unionByName(copies).groupBy(F.col("doc_id").alias("d")).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def make(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                total, gone, kept = [], [], []
                for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                    ws = words(text)
                    drop = np.zeros(len(ws), bool)
                    for s in spans or ():
                        if s["z"] >= 0:
                            drop[s["a"] : s["z"]] = True
                        else:  # a copy: all of it lies in windows, if it has one
                            drop[:] = len(ws) >= window
                    total.append(len(ws)), gone.append(int(drop.sum()))
                    kept.append(b" ".join(w for w, d in zip(ws, drop.tolist(), strict=True) if not d) if gone[-1] else b" ".join(ws))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return base.join(removed, base["doc_id"] == removed["d"], "left").drop("d").mapInArrow(make, "doc_id long, n_words long, n_removed long, kept binary")
