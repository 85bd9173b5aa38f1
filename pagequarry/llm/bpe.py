"""Byte-level BPE with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved whole by a minimal perfect hash; any other
is merged by a heap over its linked bytes. The vocabulary (tens of thousands of byte strings, fixed
size) is broadcast; documents never move.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 700_000
_ROWS = 512


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a .tiktoken file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace: n keys, n slots, one probe."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 3):
        keys = list(ranks)
        self.n, self.buckets = len(keys), max(1, len(keys) // per_bucket)
        self.shift = np.zeros(self.buckets, np.int64)
        self.keys: list[bytes] = [b""] * self.n
        self.ids: list[int] = [-1] * self.n
        groups: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in keys:
            groups[xxhash.xxh3_64_intdigest(k) % self.buckets].append(k)
        taken = bytearray(self.n)
        free = 0
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:  # a lone key goes to the next free slot, kept as a negative shift
                while taken[free]:
                    free += 1
                self.shift[b], slots = -free - 1, [free]
            else:
                d = 0
                while len({*(slots := [self._slot(k, d) for k in group])}) < len(group) or any(taken[s] for s in slots):
                    d += 1
                self.shift[b] = d
            for k, s in zip(group, slots, strict=True):
                taken[s], self.keys[s], self.ids[s] = 1, k, ranks[k]
        self.shift = self.shift.tolist()

    def _slot(self, key: bytes, d: int) -> int:
        return xxhash.xxh3_64_intdigest(key, seed=d + 1) % self.n

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        if not self.n:
            return -1
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(key, d)
        return self.ids[s] if self.keys[s] == key else -1


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a token by repeatedly merging the pair of least rank, the leftmost first.

    A piece runs from its first byte to the next piece's; the heap holds rank and place of each pair
    in one number, and a pair whose rank at its place has changed since is passed over.
    """
    n, rank = len(token), ranks.get
    bits = n.bit_length()
    mask = (1 << bits) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    now = [rank(token[i : i + 2], -1) for i in range(n - 1)]
    now.append(-1)
    heap = [r << bits | i for i, r in enumerate(now) if r >= 0]
    heapq.heapify(heap)
    while heap:
        pair = heapq.heappop(heap)
        i = pair & mask
        if now[i] != pair >> bits:
            continue
        j = after[i]
        k = after[i] = after[j]
        now[j] = now[i] = -1
        if k < n:
            before[k] = i
            r = now[i] = rank(token[i : after[k]], -1)
            if r >= 0:
                heapq.heappush(heap, r << bits | i)
        p = before[i]
        if p >= 0:
            r = now[p] = rank(token[p:k], -1)
            if r >= 0:
                heapq.heappush(heap, r << bits | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts pre-token by pre-token; a bounded memo serves the frequent ones."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, pattern: str):
        self.ranks, self.table, self.split = ranks, table, regex.compile(pattern).findall
        self.memo = _Memo(self)

    def token(self, token: str) -> tuple[int, ...]:
        raw = token.encode()
        whole = self.table.get(raw)
        return (whole,) if whole >= 0 else tuple(merge(raw, self.ranks))

    def encode(self, text: str) -> list[int]:
        if len(self.memo) > MEMO:
            self.memo.clear()
        return list(chain.from_iterable(map(self.memo.__getitem__, self.split(text))))


class _Memo(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = self.encoder.token(token)
        if len(token) < 64:
            self[token] = ids
        return ids


_encoders: dict[tuple, Encoder] = {}


def _kept_encoder(shared, name: str, pattern: str) -> Encoder:
    """This worker process's encoder, whose memo serves one task after another."""
    key = (name, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value, pattern)
    return _encoders[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``ids array<int>``, the ranks of ``text`` without special tokens.

    Null and empty texts give an empty array. Other columns pass through (a column named ``ids`` is
    replaced); repeated rows give repeated rows; an empty table stays empty.
    """
    ranks = load_ranks(path)
    name = xxhash.xxh3_128_hexdigest(b"".join(b"%d:%b " % (r, t) for t, r in sorted(ranks.items())))
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))

    def run(batches):
        encoder = _kept_encoder(shared, name, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                ids = [encoder.encode(t or "") for t in b.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, offsets[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*b.schema.names, "ids"])

    kept = docs.drop("ids").withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(run, kept.select("*", F.array(F.lit(0)).alias("ids")).schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded binary``, the bytes of its ``ids``; null ids give null."""
    ranks = load_ranks(path)
    shared = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def run(batches):
        token = shared.value.__getitem__
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                b = whole.slice(at, _ROWS)
                raw = [None if x is None else b"".join(map(token, x)) for x in b.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "decoded"])

    kept = encoded.drop("decoded")
    return kept.mapInArrow(run, kept.select("*", F.lit(None).cast("binary").alias("decoded")).schema)
