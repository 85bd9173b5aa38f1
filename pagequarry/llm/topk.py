"""Exact top-k inner-product search by distributed histogram selection.

Every query is scored against every row, block against block. Global histograms of the scores are
refined level by level until each query's k-th best score is known to the unit; one more pass keeps
what reaches it, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut

LEVEL_BITS = 8
#: Query blocks whose histograms a task sums before it sends them on.
HELD = 64
_LIMIT = 1 << 26


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, dim, vec)``: vectors as ``floor(scale * x)``, x as double.

    Rows whose vector is null or holds a null or non-finite component, and rows without an id, take
    no part. Components of 2^26 or more in size after scaling are refused, since sums of their
    products need not fit a long.
    """
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    small = F.forall(F.col("embedding").cast("array<double>"), lambda x: F.abs(x * scale) < _LIMIT)
    return (
        rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(sound)
        .select("vec_id", F.size("embedding").alias("dim"), F.when(small, v).otherwise(F.raise_error(F.lit("vector component too large"))).alias("vec"))
    )


def _blocks(vectors: DataFrame, rows_in_block: int, name: str) -> DataFrame:
    """``(<name>, dim, ids, m)``: blocks of vectors as packed int32, ids and rows in one order."""

    def run(batches: Iterator[pa.RecordBatch]):
        kept: dict[int, list] = {}

        def out(dim, got):
            ids, vecs = zip(*got, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([np.array(vecs, "<i4").reshape(len(ids), dim).tobytes()], pa.binary())],
                ["dim", "ids", "m"],
            )

        for b in batches:
            for i, d, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "dim", "vec")), strict=True):
                got = kept.setdefault(d, [])
                got.append((i, v))
                if len(got) == rows_in_block:
                    yield out(d, got)
                    got.clear()
        for d, got in kept.items():
            if got:
                yield out(d, got)

    return vectors.mapInArrow(run, "dim int, ids binary, m binary").withColumn(name, F.xxhash64("dim", "ids"))


def _matrix(m: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(m, "<i4").reshape(-1, dim) if dim else np.zeros((0, 0), "<i4")


def _scores(qids, qm, cids, cm, dim):
    """Scores as int64, and a mask of the pairs that count (not a row with itself)."""
    q, c = np.frombuffer(qids, "<i8"), np.frombuffer(cids, "<i8")
    if not dim:
        s = np.zeros((len(q), len(c)), np.int64)
    else:
        a, b = _matrix(qm, dim), _matrix(cm, dim)
        top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * dim
        # Doubles hold these sums exactly up to 2^53; beyond that integers do.
        s = (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if top < 1 << 53 else a.astype(np.int64) @ b.T.astype(np.int64)
    return q, c, s, q[:, None] != c[None, :]


def _beside(q: DataFrame, r: DataFrame, spread: int) -> DataFrame:
    """Every query block beside every row block of its dimension.

    A stated query set against all rows: the row blocks are dealt to ``spread`` groups and each group
    gets one copy of each query block, so a row block is moved once.
    """
    q = q.select("qb", F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("m").alias("qm"), "known", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("qg"))
    r = r.select("dim", "ids", "m", F.pmod("rb", F.lit(spread)).cast("int").alias("g"))
    return r.join(q, (F.col("g") == F.col("qg")) & (F.col("dim") == F.col("qdim"))).select("dim", "ids", "m", "qb", "qids", "qm", "known")


def top_k(rows: DataFrame, k: int = 5, every: int = 50, query_block: int = 256, row_block: int = 1024) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best rows for each row whose id divides by ``every``.

    Ties go to the smaller vec_id; a query with fewer than k candidates gets all. Vectors are compared
    with those of their own length only. Extra columns are ignored; an empty table gives no rows;
    a repeated row is a candidate each time and a query once.
    """
    vectors = quantised(rows)
    q = cut(_blocks(vectors.filter(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), query_block, "qb"))
    r = cut(_blocks(vectors, row_block, "rb"))
    spread = max(8, r.count() // 8)
    top = _bound(q, "qm") * _bound(r, "rm")
    levels = max(1, -(-(2 * top + 1).bit_length() // LEVEL_BITS))
    # state: for each query, the interval that holds its k-th best score and how many lie above it.
    state = None
    for level in reversed(range(levels)):
        state = cut(_refine(_beside(_with_state(q, state), r, spread), state, k, -top, level))
    return _select(_beside(_with_state(q, state), r, spread), k, -top)


def _bound(blocks: DataFrame, name: str) -> int:
    """A bound such that no score exceeds the product of both sides' (one number)."""

    def run(batches):
        for b in batches:
            norms = [float(np.sqrt((_matrix(m, d).astype(np.float64) ** 2).sum(axis=1)).max(initial=0)) for d, m in zip(b.column("dim").to_pylist(), b.column("m").to_pylist(), strict=True) if d]
            yield pa.RecordBatch.from_arrays([pa.array([max([0.0, *norms])])], [name])

    top = blocks.select("dim", "m").mapInArrow(run, f"{name} double").agg(F.max(name)).first()[0] or 0.0
    return int(top) + 2


def _with_state(q: DataFrame, state: DataFrame | None) -> DataFrame:
    """Beside each block of queries, what is known of them."""
    if state is None:
        return q.withColumn("known", F.lit(None).cast("array<struct<q:long,at:long>>"))
    known = state.groupBy(F.col("qb").alias("kb")).agg(F.collect_list(F.struct("q", "at")).alias("known"))  # one block of queries
    return q.join(known, F.col("qb") == F.col("kb")).drop("kb")


def _refine(pairs: DataFrame, state: DataFrame | None, k: int, low: int, level: int) -> DataFrame:
    """One level: histogram the scores inside each query's interval and step into the k-th one's bin."""
    shift, bins = LEVEL_BITS * level, 1 << LEVEL_BITS

    def rows_of(qb, q, at, n):
        where = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(where), qb, np.int64)), pa.array(q[where // bins]), pa.array((at[where // bins] << LEVEL_BITS) + where % bins), pa.array(n[where].astype(np.int64))],
            ["qb", "q", "bin", "n"],
        )

    def run(batches):
        # Sums of some query blocks over all the row blocks that the task meets; the oldest goes when there are too many.
        sums: dict[int, tuple] = {}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                q, _, s, mask = _scores(row["qids"], row["qm"], row["ids"], row["m"], row["dim"])
                if row["known"] is None:
                    at = np.zeros(len(q), np.int64)
                else:
                    known = {x["q"]: x["at"] for x in row["known"]}
                    at = np.array([known.get(x, -1) for x in q.tolist()], np.int64)
                # `at` numbers the interval on the level above; bins are numbered within it.
                bin_ = ((s - low) >> shift) - (at[:, None] << LEVEL_BITS)
                mask = mask & (bin_ >= 0) & (bin_ < bins)
                flat = (np.arange(len(q))[:, None] * bins + bin_)[mask]
                n = np.bincount(flat, minlength=len(q) * bins)
                if row["qb"] in sums:
                    sums[row["qb"]][2][:] += n
                else:
                    sums[row["qb"]] = (q, at, n)
                    if len(sums) > HELD:
                        yield rows_of((oldest := next(iter(sums))), *sums.pop(oldest))
        for qb, held in sums.items():
            yield rows_of(qb, *held)

    hist = pairs.mapInArrow(run, "qb long, q long, bin long, n long").groupBy("qb", "q", "bin").agg(F.sum("n").alias("n"))
    if state is None:
        hist = hist.withColumn("before", F.lit(0).cast("long"))
    else:
        hist = hist.join(state.select(F.col("q").alias("sq"), F.col("above").alias("before")), F.col("q") == F.col("sq")).drop("sq")
    # A query has at most 2^LEVEL_BITS bins here.
    per_query = hist.groupBy("qb", "q", "before").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    step = F.aggregate(
        "bins",
        F.struct(F.col("before").alias("above"), F.lit(None).cast("long").alias("at"), F.lit(False).alias("done")),
        lambda acc, x: F.when(acc["done"], acc).otherwise(
            F.struct(
                F.when(acc["above"] + x["n"] >= k, acc["above"]).otherwise(acc["above"] + x["n"]).alias("above"),
                x["bin"].alias("at"),
                (acc["above"] + x["n"] >= k).alias("done"),
            )
        ),
    )
    # With fewer than k scores in all, the lowest bin is stepped into and everything reaches it.
    return per_query.select("qb", "q", step.alias("s"), F.element_at("bins", -1)["n"].alias("last")).select(
        "qb", "q", F.col("s.at").alias("at"), F.when(F.col("s.done"), F.col("s.above")).otherwise(F.col("s.above") - F.col("last")).alias("above")
    )


def _select(pairs: DataFrame, k: int, low: int) -> DataFrame:
    """Rows that reach the k-th score; a block sends at most k for each query, the best by (score, id)."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                q, c, s, mask = _scores(row["qids"], row["qm"], row["ids"], row["m"], row["dim"])
                known = {x["q"]: low + x["at"] for x in row["known"]}
                floor = np.array([known.get(x, np.iinfo(np.int64).max) for x in q.tolist()], np.int64)
                mask = mask & (s >= floor[:, None])
                out_q, out_c, out_s = [], [], []
                for j in np.flatnonzero(mask.any(axis=1)):
                    hit = np.flatnonzero(mask[j])
                    best = hit[np.lexsort((c[hit], -s[j, hit]))[:k]]
                    out_q += [int(q[j])] * len(best)
                    out_c += c[best].tolist()
                    out_s += s[j, best].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_c, pa.int64()), pa.array(out_s, pa.int64())], ["query_id", "vec_id", "score"])

    got = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    ranked = got.withColumn("rank", F.expr("row_number() over (partition by query_id order by score desc, vec_id)").cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
