"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition keeps a fixed number of open windows. A document's full windows go out as they are;
its remainder goes to the open window that it fits best. When none fits and all windows are in use,
the fullest is filled by a cut of the document (or padded, if the gap is tiny) and emitted. What is
left open at the end of the partitions is merged, a few partitions at a time.
"""

from __future__ import annotations

import gc
import os
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut

LENGTH, OPEN, TINY_GAP, MERGED = 4096, 32, 16, 5
#: Entries of a memo, and bytes of its longest key.
_MEMO, _MEMO_BYTES = 750_000, 48
_CUTTABLE = b".,!?;:%&*$#"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class WordTokens:
    """Token ids of texts, chunk by chunk between white space, as the tokenizer gives for the whole.

    The tokenizer drops white space and never merges across it, so chunks are independent. A memo of
    bounded size serves repeated chunks. Trailing ASCII punctuation after a Latin letter or digit is a
    pre-token of its own and is looked up apart, so there are few variants; new chunks that are words
    of Latin letters are encoded together, and their ids told apart by their place in the text. The
    strings of special tokens in a text become these tokens' ids, as the library has it by default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids as little-endian 32-bit numbers, so that a text's ids are a join of bytes.
        self.known: dict[bytes, bytes] = {}
        self.fresh: set[bytes] = set()

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        parts, wanted = [], set()
        for chunk in new:
            core = chunk.rstrip(_CUTTABLE)
            mark = chunk[len(core) :]
            if core.isascii() and core[-1:].isalnum():
                core = core if b"<" in core else core.lower()  # a special token's string counts as it is
            elif not core or not "0" <= (last := core[-2:].decode(errors="ignore")[-1:]) <= "ɏ" or not last.lower()[-1:].isalnum():
                # A dotted capital I leaves a combining dot in lower case, which goes with the mark.
                core, mark = chunk, b""
            parts.append((chunk, core, mark))
            if core not in known:
                wanted.add(core)
            if mark and mark not in known:
                wanted.add(mark)
        words, rest = [], []
        for core in wanted:
            if core.isalpha():  # ASCII letters
                words.append(core)
            else:
                text = core.decode()
                (words if text.isalpha() and max(text) <= "ɏ" else rest).append(core)
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            got = self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in some]
            ends = list(accumulate(len(w.decode()) + 1 for w in some))
            for (start, _), i in zip(got.offsets, got.ids, strict=True):
                ids[bisect_right(ends, start)].append(i)
            known.update((core, struct.pack(f"<{len(x)}I", *x)) for core, x in zip(some, ids, strict=True))
        for core in rest:
            x = self.tokenizer.encode(core.decode(), add_special_tokens=False).ids
            known[core] = struct.pack(f"<{len(x)}I", *x)
        self.fresh = wanted | new
        for chunk, core, mark in parts:
            known[chunk] = known[core] + known[mark] if mark else known[core]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > _MEMO:
            self.known.clear()
        split = [t.encode().split() for t in texts]
        # The memo's many objects hold no cycles; collecting them again and again would take long.
        collects = gc.isenabled()
        gc.disable()
        try:
            found = [list(map(self.known.get, s)) for s in split]
            partly = [i for i, f in enumerate(found) if None in f]
            self._learn({c for i in partly for c, x in zip(split[i], found[i], strict=True) if x is None})
            for i in partly:
                found[i] = list(map(self.known.__getitem__, split[i]))
            for long in [c for c in self.fresh if len(c) > _MEMO_BYTES]:
                del self.known[long]
            self.fresh.clear()
            return [np.frombuffer(b"".join(f), "<u4") for f in found]
        finally:
            if collects:
                gc.enable()


_tokenizers: dict[str, WordTokens] = {}


def _kept_tokens(path: str) -> WordTokens:
    """This worker process's tokens, whose memo serves one task after another."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokens(path)
    return _tokenizers[path]


class Packer:
    """Open windows of one partition. ``out`` receives (piece, window, offset); a piece is (doc, start, ids, doc_tokens)."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN, tiny_gap: int = TINY_GAP):
        self.length, self.most_open, self.tiny_gap = length, most_open, tiny_gap
        self.gaps: list[tuple[int, int]] = []  # (gap, window) of open windows, by gap
        self.next = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        for at in range(0, n - n % self.length, self.length):
            self.out.append(((doc, at, ids[at : at + self.length], n), self.next, 0))
            self.next += 1
        if n % self.length:
            self.place(doc, n - n % self.length, ids[n - n % self.length :], n)

    def place(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while True:
            i = bisect_left(self.gaps, (len(ids), -1))
            if i < len(self.gaps):
                gap, w = self.gaps.pop(i)
            elif len(self.gaps) < self.most_open:
                gap, w = self.length, self.next
                self.next += 1
            else:  # the fullest goes; a cut fills it unless next to nothing is missing
                gap, w = self.gaps.pop(0)
                if gap > self.tiny_gap:
                    self.out.append(((doc, start, ids[:gap], total), w, self.length - gap))
                    start, ids = start + gap, ids[gap:]
                continue
            self.out.append(((doc, start, ids, total), w, self.length - gap))
            if gap > len(ids):
                insort(self.gaps, (gap - len(ids), w))
            return

    def left_open(self) -> set[int]:
        return {w for _, w in self.gaps}


def _piece(piece, sequence: int, offset: int, keep: bool) -> tuple:
    doc, start, ids, total = piece
    raw = ids.astype("<u4").tobytes()
    return doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw if keep else None


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = LENGTH, most_open: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    Each document's ids, and ``end_id`` after them, lie in its pieces once and in order; a sequence's
    pieces fill it from offset 0 without a gap. A null or empty text has the end id alone. Other
    columns are ignored; a repeated row is packed each time; an empty table gives no rows.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        words, packer = _kept_tokens(tokenizer_path), Packer(length, most_open)
        held: dict[int, list] = {}

        def rows(open_now, last):
            ready = []
            for piece, w, offset in packer.out:
                if w in open_now or w in held:
                    held.setdefault(w, []).append((piece, offset))
                else:
                    ready.append(_piece(piece, part << 32 | w, offset, with_ids))
            packer.out.clear()
            for w in [w for w in held if w not in open_now]:
                ready += [_piece(p, part << 32 | w, o, with_ids) for p, o in held.pop(w)]
            out = [(*r, None) for r in ready]
            if last:
                out += [(*_piece(p, w, o, True), part) for w, pieces in held.items() for p, o in pieces]
            return _batch(out)

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                texts = [t or "" for t in b.column("text").to_pylist()]
                for doc, ids in zip(b.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                    packer.add(doc, np.append(ids, np.uint32(end_id)))
                yield rows(packer.left_open(), False)
        yield rows(packer.left_open(), True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """The windows that MERGED partitions left open, laid end to end and cut at full windows."""
        pdf = pdf.sort_values(["part", "sequence_id", "offset"], kind="stable")
        base = (1 << 62) | int(pdf["part"].iloc[0]) // MERGED << 32
        at, out = 0, []
        for doc, start, raw, total in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True):
            ids = np.frombuffer(raw, "<u4")
            while len(ids):
                n = min(len(ids), length - at % length)
                out.append(_piece((doc, start, ids[:n], total), base | at // length, at % length, with_ids))
                at, start, ids = at + n, start + n, ids[n:]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PIECE.split(", ")]).astype({"doc_id": "Int64"})

    made = cut(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"{_PIECE}, part long"))
    done = made.filter("part is null").drop("part")
    merged = made.filter("part is not null").groupBy(F.floor(F.col("part") / MERGED).alias("g")).applyInPandas(merge, _PIECE)
    both = done.unionByName(merged)
    return both if with_ids else both.drop("ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.binary(), pa.int64()]
    names = [c.split()[0] for c in _PIECE.split(", ")] + ["part"]
    columns = list(zip(*rows, strict=True)) if rows else [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
