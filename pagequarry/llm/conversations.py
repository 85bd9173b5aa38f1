"""Repair of damaged conversations by the cheapest edits.

A conversation's rows and the states of its grammar span a lattice: each edit of the next row, and each
inserted row, is a step to another node. Dijkstra's search with the key (cost, audit) finds the edits.
Rows are dealt by ranges of conversation and turn, so that a conversation of any length is spread over
tasks; each piece of it is searched from every state it may begin in, and a second search, of the same
kind, goes over the pieces.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagequarry.llm._runtime import cut, stage

# What an edit costs, and what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A row's first fault.
BLANK, DUPLICATE, CUT = 1, 2, 3
# States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a.
NONE, S, U, A = range(4)
STATES, ENDS = (NONE, S, U, A), (NONE, A)
NEXT = {(NONE, "s"): S, (NONE, "u"): U, (S, "u"): U, (A, "u"): U, (U, "a"): A}
NAMES = {"u": "user", "a": "assistant"}
#: A piece ends at so many rows, or when its texts reach so many characters.
ROWS, CHARS = 512, 4_000_000
LEGAL = ("su", "ua", "au")
#: So many texts that come at several turns are broadcast, of fixed size each; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def damaged(talks: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, n)``: a row's damage by the CRC-32 of ``conv_id:turn`` mod 20; n is how often it then stands there.

    0 drops a row (n is 0, and only conv_id is left), 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats it, 4 sets its role to user. Null values are read as one space; a null turn stays null.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    rows = talks.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind"))
    there = F.col("kind") != 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).alias("role"),
        F.when(there, text).alias("text"),
        F.when(there, F.when(F.col("kind") == 3, 2).otherwise(1)).otherwise(0).cast("long").alias("n"),
    )


def as_they_are(talks: DataFrame) -> DataFrame:
    """The same columns without any damage."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return talks.select("conv_id", F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), F.lit(1).cast("long").alias("n"))


def _faulty(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number ``n``, the fault of the first of them, and a ``digest`` of role and text.

    A row is a duplicate if its conversation has its role and text at a smaller turn. Only those of
    several turns are looked up again, so a text that is said very often meets by its counts.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    mark = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(0)
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    once = once.withColumns({"digest": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256), "fault": mark})
    turns = once.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k"))
    several = cut(turns.filter("k > 1 and d is not null").select("c", "d", "first"))
    several = F.broadcast(several) if several.count() <= BROADCAST_ROWS else several
    met = once.join(several, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    later = F.col("first").isNotNull() & (F.col("first") != F.struct("turn"))
    return met.select("conv_id", "turn", "role", "text", "n", "digest", F.when((F.col("fault") != BLANK) & later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


def steps(state: int, role: str, fault: int) -> Iterator[tuple[int, str, int]]:
    """``(cost, initial, state)`` of each edit of a row."""
    yield DELETE, "D", state
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED if fault == CUT else 0
    if (state, role[:1]) in NEXT:
        yield KEEP + more, "K", NEXT[state, role[:1]]
    for to in "ua":
        if (state, to) in NEXT:
            yield REROLE + more, "R", NEXT[state, to]


def search(rows: list[tuple[str, int]], begin: int, tail: bool) -> dict[int, tuple[int, str]]:
    """The least ``(cost, audit)`` to each state past ``rows(role, fault)`` from ``begin``.

    With ``tail`` the conversation ends there: rows may be inserted at its end, and the search stops at the first accepting
    node it takes up. Otherwise inserted rows come before a row only, so that each sequence of edits has one way of being cut in pieces.
    """
    end, done, found = len(rows), set(), {}
    heap = [(0, "", 0, begin)]
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == end:
            if not tail:
                found[state] = (cost, audit)
                if len(found) == len(STATES):
                    break
                continue
            if state in ENDS:
                return {state: (cost, audit)}
        else:
            for more, letter, to in steps(state, *rows[at]):
                if (at + 1, to) not in done:
                    heapq.heappush(heap, (cost + more, audit + letter, at + 1, to))
        for letter in "ua":
            to = NEXT.get((state, letter))
            if to is not None and (at, to) not in done:
                heapq.heappush(heap, (cost + INSERT, f"{audit}I", at, to))
    return found


def over_pieces(pieces: list[dict[int, dict[int, tuple[int, str]]]]) -> tuple[int, list[tuple[int, str]]]:
    """The least cost over pieces, each ``{begin: {end: (cost, audit)}}``, and the state and audit that each piece begins with.

    Audits of one piece that cost the same never begin with one another: they take up as many rows and end with a row's
    edit. So lists of them are ordered as they are when joined.
    """
    done = set()
    heap: list[tuple[int, list[str], int, int, tuple | None]] = [(0, [], 0, NONE, None)]
    while heap:
        cost, audits, at, state, _ = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done.add((at, state))
        if at == len(pieces):
            state, out = NONE, []
            for piece, audit in zip(pieces, audits, strict=True):
                out.append((state, audit))
                state = next(end for end, (_, a) in piece[state].items() if a == audit)
            return cost, out
        for to, (more, audit) in pieces[at].get(state, {}).items():
            if (at + 1, to) not in done:
                heapq.heappush(heap, (cost + more, [*audits, audit], at + 1, to, None))
    raise ValueError("no edits lead to an accepted conversation")


def apply(rows: Iterable[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """The repaired ``(role, text)`` rows: what the audit's edits make of ``rows``, from a state on."""
    rows = iter(rows)
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = NAMES["a" if state == U else "u"]
        state = NEXT[state, role[:1]]
        yield role, text


class Piece:
    """Consecutive rows of one conversation, and what is known of them."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.faults, self.turns, self.chars = conv_id, [], [], [], 0

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.chars >= CHARS

    def add(self, turn: int | None, role: str, text: str | None, fault: int) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        self.chars += len(text or "")
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def facts(self) -> dict:
        heads = [role[:1] for role, _ in self.rows]
        return {
            **{name: self.faults.count(fault) for name, fault in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT))},
            "illegal": sum(a + b not in LEGAL for a, b in zip(heads, heads[1:], strict=False)),
            "first": heads[0] if heads else None,
            "last": heads[-1] if heads else None,
            "low": self.turns[0] if self.turns else None,
            "high": self.turns[-1] if self.turns else None,
            "turns": len(self.turns),
        }

    def lattice(self) -> list[tuple[str, int]]:
        return [(role, fault) for (role, _), fault in zip(self.rows, self.faults, strict=True)]

    def ways(self, tail: bool) -> list[dict]:
        rows = self.lattice()
        return [{"begin": b, "end": e, "cost": c, "audit": a} for b in STATES for e, (c, a) in search(rows, b, tail).items()]


def together(facts: list[dict]) -> dict:
    """The facts of a conversation from those of its pieces, in order."""
    out = {name: sum(f[name] for f in facts) for name in ("blank", "duplicate", "truncated", "illegal", "turns")}
    own = [f for f in facts if f["first"] is not None]
    out["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(own, own[1:], strict=False))
    timed = [f for f in own if f["turns"]]
    distinct = out.pop("turns") - sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:], strict=False))
    out["gaps"] = timed[-1]["high"] - timed[0]["low"] + 1 - distinct if timed else 0
    return out


def _pieces(rows: Iterable[tuple], most: int) -> Iterator[tuple[Piece, bool, bool]]:
    """The pieces of a task's sorted ``(conv_id, turn, role, text, n, fault)``; whether each is its conversation's first there, and its last."""
    piece, first = None, True
    for conv_id, turn, role, text, n, fault in rows:
        if piece is not None and conv_id != piece.conv_id:
            yield piece, first, True
            piece = None
        if piece is None:
            piece, first = Piece(conv_id), True
        for copy in range(n):
            if piece.full(most):
                yield piece, first, False
                piece, first = Piece(conv_id), False
            piece.add(turn, role, text if copy == 0 else None, fault if copy == 0 or fault == BLANK else DUPLICATE)
    if piece is not None:
        yield piece, first, True


def _hashed(rows: Iterable[tuple[str, str]], so_far=None):
    """SHA-256 of ``role:text`` lines, going on from ``so_far``, a pair of a hash and whether it has lines."""
    h, more = so_far or (hashlib.sha256(), False)
    for role, text in rows:
        h.update(f"{chr(10) if more else ''}{role}:{text or ''}".encode())
        more = True
    return h, more


FACTS = "blank long, duplicate long, truncated long, illegal long"
RESULT = f"gaps long, {FACTS}, cost long, audit string, repaired_sha256 string"
WAYS = "array<struct<begin:int,end:int,cost:long,audit:string>>"
OPEN = f"piece long, facts struct<blank:long,duplicate:long,truncated:long,illegal:long,first:string,last:string,low:long,high:long,turns:long>, ways {WAYS}, tail {WAYS}, rows array<struct<role:string,text:string>>"


def _batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 1000 + sum(len(x["text"] or "") for x in row.get("rows") or ())
        if weight > CHARS:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def _task(batches: Iterable[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """A task's conversations: solved if all of one is in one piece there, else its pieces with their ways."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def one(piece, whole, at):
        if whole:
            ((cost, audit),) = search(piece.lattice(), NONE, True).values()
            h, _ = _hashed(apply(piece.rows, audit, NONE))
            return {"conv_id": piece.conv_id, **together([piece.facts()]), "cost": cost, "audit": audit, "repaired_sha256": h.hexdigest()}
        rows = [{"role": r, "text": t} for r, t in piece.rows]
        return {"conv_id": piece.conv_id, "piece": number + at, "facts": piece.facts(), "ways": piece.ways(False), "tail": piece.ways(True), "rows": rows}

    def run():
        before, edge = None, True
        for at, now in enumerate(_pieces(_streamed(batches), most)):
            if before is not None:
                piece, first, last = before
                # The first conversation of a task may have begun in another, and the last may go on there.
                yield one(piece, first and last and not edge, at - 1)
                edge = edge and not last
            before = now
        if before is not None:
            yield one(before[0], False, at)

    return _batches(run(), schema)


def _chosen(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """For each conversation's pieces, sorted, the edits of each; the first has the conversation's facts too."""

    def solved(conv_id, pieces):
        ways = []
        for i, (_, _, _, between, tail) in enumerate(pieces):
            table: dict = {}
            for w in tail if i == len(pieces) - 1 else between:
                table.setdefault(w["begin"], {})[w["end"]] = (w["cost"], w["audit"])
            ways.append(table)
        cost, edits = over_pieces(ways)
        facts = together([p[2] for p in pieces]) | {"cost": cost, "audit": "".join(a for _, a in edits)}
        for p, (state, audit) in zip(pieces, edits, strict=True):
            yield {"piece": p[1], "state": state, "edits": audit, **facts}
            facts = {}

    def run():
        held: list[tuple] = []
        for row in _streamed(batches):
            if held and held[0][0] != row[0]:
                yield from solved(held[0][0], held)
                held = []
            held.append(row)
        if held:
            yield from solved(held[0][0], held)

    return _batches(run(), schema)


def _joined(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sorted pieces with their edits; texts are hashed as they pass."""

    def run():
        now, so_far = None, None
        for conv_id, _, rows, state, edits, *facts in _streamed(batches):
            if now is None or now["conv_id"] != conv_id:
                if now is not None:
                    yield now | {"repaired_sha256": so_far[0].hexdigest()}
                now, so_far = {"conv_id": conv_id} | dict(zip(schema.names[1:], facts, strict=False)), None
            so_far = _hashed(apply([(r["role"], r["text"]) for r in rows], edits, state), so_far)
        if now is not None:
            yield now | {"repaired_sha256": so_far[0].hexdigest()}

    return _batches(run(), schema)


def repair(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row a conv_id of ``rows(conv_id, turn, role, text, n)``.

    A conversation's rows go by turn (null first; ties by role and text, bytewise). A row's first
    fault counts: blank, duplicate (role and text seen earlier), truncated. The audit is the initials of the cheapest
    edits, the ASCII-least if several cost the same: Keep, Rerole, Delete, Insert. Rows with n = 0 stand for their
    conversation only; one without other rows has zeros, an empty audit and the hash of nothing. Roles
    of other initials, or of none, can be deleted or changed only. A null conv_id is a conversation like others; equal rows
    come once with their number. An empty table gives no rows. A piece has ``most`` rows at most.

    The audit and the hash are values of one row, so a conversation's audits, a character a row, and the
    stream of its texts pass one task; all else is spread over many however long a conversation is.
    """
    id_type = rows.schema["conv_id"].dataType.simpleString()
    found = stage(_faulty(rows).select("conv_id", "turn", "role", "text", "n", "fault"), "rows")
    order = ("conv_id", "turn", "role")
    dealt = found.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    schema = StructType.fromDDL(f"conv_id {id_type}, {RESULT}, {OPEN}")
    arrow = to_arrow_schema(schema)
    solved = stage(dealt.mapInArrow(lambda b: _task(b, arrow, most), schema), "pieces")
    result = ["conv_id", *StructType.fromDDL(RESULT).names]
    open_ = solved.filter("piece is not null")
    light = open_.select("conv_id", "piece", "facts", "ways", "tail").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    choice = StructType.fromDDL(f"piece long, state int, edits string, gaps long, {FACTS}, cost long, audit string")
    arrow_choice = to_arrow_schema(choice)
    edits = stage(light.mapInArrow(lambda b: _chosen(b, arrow_choice), choice), "edits")
    texts = open_.select("conv_id", "piece", "rows").join(edits, "piece")
    texts = texts.select("conv_id", "piece", "rows", *edits.columns[1:]).repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    last = StructType.fromDDL(f"conv_id {id_type}, {RESULT}")
    arrow_last = to_arrow_schema(last)
    return solved.filter("piece is null").select(*result).unionByName(texts.mapInArrow(lambda b: _joined(b, arrow_last), last))
