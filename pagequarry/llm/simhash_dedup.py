"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Of two fingerprints that differ in at most
two bits, one segment differs in at most one, so both rows carry either the same segment or the
same segment with one bit wildcarded. Those 66 signatures per *distinct* fingerprint are joined by
equality and the pairs verified.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut
from pagequarry.llm.components import connected_components

SEED = 42
_STEP = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; 0 for null or wordless text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(grams), _STEP):
        part = grams[at : at + _STEP]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(grams), bitorder="little").tobytes(), "little")


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signatures(fps: DataFrame) -> DataFrame:
    """``(key, side, fp)``: each segment as it is, and with each of its bits wildcarded."""
    half = (F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))
    out = []
    for s, v in enumerate(half):
        out.append(F.struct((v + ((s << 6 | 32) << 32)).alias("key"), F.lit(-1).alias("side")))
        for p in range(32):
            out.append(
                F.struct(
                    (v.bitwiseAND(0xFFFFFFFF ^ (1 << p)) + ((s << 6 | p) << 32)).alias("key"),
                    F.shiftright(v, p).bitwiseAND(1).cast("int").alias("side"),
                )
            )
    return fps.select("fp", F.explode(F.array(*out)).alias("s")).select("s.key", "s.side", "fp")


def link_fingerprints(fps: DataFrame, bucket: int = 32) -> DataFrame:
    """Links ``(src, dst)`` that connect exactly the distinct ``fps(fp)`` within two bits.

    Buckets of up to ``bucket`` fingerprints are joined pair by pair. A fuller one (a large family
    of near copies) is not: each of its fingerprints is filed under itself and its 64 one-bit
    neighbours. Two fingerprints within two bits share such a neighbour, and all that share one,
    65 at most, are within two bits; so each is tied to the smallest, and no link is lost.
    """
    sig = _signatures(fps)
    full = sig.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = cut(sig.join(full, "key"))
    cold = met.filter(F.col("n") <= bucket)
    a, b = cold.alias("a"), cold.alias("b")
    pairs = (
        a.join(b, F.expr("a.key = b.key and a.fp < b.fp and (a.side = -1 or a.side <> b.side)"))
        .filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= 2)
        .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    )
    hot = met.filter(F.col("n") > bucket).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR((1 << p) if p < 63 else -(1 << 63)) for p in range(64)])
    stars = (
        hot.select("fp", F.explode(near).alias("mid"))
        .groupBy("mid")
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select(F.array_min("fps").alias("src"), F.explode("fps").alias("dst"))
        .filter("src <> dst")
    )
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Null, empty and wordless
    texts have fingerprint 0 and are linked like any other. Repeated rows give repeated rows. A null
    doc_id is kept and never becomes a component's id unless the component has no other. An empty
    table gives no rows.
    """
    marked = cut(with_fingerprints(docs, shingle))
    fps = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = connected_components(link_fingerprints(fps.select("fp")))
    # Only the fingerprints with a link are in comp; the others stand for themselves.
    named = fps.join(comp, fps["fp"] == comp["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = named.join(ids, "component").select(F.col("fp").alias("k"), "component_id")
    return marked.join(of_fp, marked["fp"] == of_fp["k"]).select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is its component's smallest, with their columns unchanged.

    Rows without a doc_id are kept, as no row can be told to stand for them.
    """
    drop = near_duplicates(docs, shingle).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
