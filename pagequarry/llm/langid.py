"""Language identification by cross-parsing against suffix automata.

A bounded sample of labelled text per language becomes a suffix automaton. A text is parsed greedily
into the longest phrases that occur in a language's sample; the language that needs the fewest
phrases, normalised by the phrase cost in bits and the text's length, wins. All letters of the samples
are known; another letter, or one that a language lacks, is a phrase of its own at a fixed cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_CHARS = 24_000
#: Texts are parsed in pieces side by side; each starts so many letters early, to be in step with the piece before it.
CHUNK, WARM = 512, 96
#: What a letter that a language lacks costs, in bits, the same for all languages.
LITERAL = 16.0
#: Up to so many entries the transitions are a plain table, beyond it a hash table; both give the same.
DENSE = 12_000_000
UNDETERMINED = "und"
_LANES = 1 << 13
_POINTS = 0x110000
_is_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.fromiter((chr(c).isalpha() for c in range(_POINTS)), np.bool_, _POINTS)
    return _is_letter


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Alphabet:
    """Codes of code points: 0 a break (any run of other characters), 1 an unknown letter, then the known letters."""

    def __init__(self, known: list[int]):
        self.known = known
        self.size = len(known) + 2
        self.of = _letters().astype(np.uint32)
        self.of[known] = np.arange(2, self.size, dtype=np.uint32)

    def codes(self, text: str) -> np.ndarray:
        c = self.of[_points(text)]
        if not len(c):
            return c
        keep = c != 0
        keep[1:] |= c[:-1] != 0
        return c[keep]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions ``[state][code] -> state`` of the suffix automaton; state 1 is the root, 0 none."""
    rows: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in codes.tolist():
        cur = len(rows)
        rows.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p and c not in rows[p]:
            rows[p][c] = cur
            p = link[p]
        if not p:
            link[cur] = 1
        elif length[q := rows[p][c]] == length[p] + 1:
            link[cur] = q
        else:
            clone = len(rows)
            rows.append(dict(rows[q])), link.append(link[q]), length.append(length[p] + 1)
            while p and rows[p].get(c) == q:
                rows[p][c] = clone
                p = link[p]
            link[q] = link[cur] = clone
        last = cur
    return rows


class Model:
    """The automata of all languages: their transitions in one table, hashed if the alphabet is large."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        ok = _letters()
        self.known = sorted({int(c) for text in samples.values() for c in np.unique(_points(text)) if ok[c]})
        alphabet = Alphabet(self.known)
        self.width = alphabet.size
        self.roots, self.bits, at, keys, targets = [], [], 1, [], []
        for lang in self.langs:
            codes = alphabet.codes(samples[lang])
            rows = suffix_automaton(codes)
            self.roots.append(at)
            self.bits.append(float(np.log2(max(2, len(codes)))))
            for s, row in enumerate(rows[1:]):
                keys += [(s + at) * self.width + c for c in row]
                targets += [t + at - 1 for t in row.values()]
            at += len(rows) - 1
        key, target = np.array(keys, np.int64), np.array(targets, np.int32)
        self.dense = None
        if at * self.width <= DENSE:
            self.dense = np.zeros(at * self.width, np.int32)
            self.dense[key] = target
            return
        self.shift = 64 - max(4, (2 * len(keys)).bit_length())
        self.slots = np.full((1 << 64 - self.shift) + 1024, -1, np.int64)
        self.to = np.zeros(len(self.slots), np.int32)
        self.slots[-1] = -2  # the end of the last run
        wait = np.arange(len(keys))
        slot = self._slot(key)
        while len(wait):  # those that find a free slot first take it, the others move on
            free = self.slots[slot[wait]] == -1
            first = np.zeros(len(wait), bool)
            first[np.unique(slot[wait], return_index=True)[1]] = True
            put = wait[free & first]
            self.slots[slot[put]], self.to[slot[put]] = key[put], target[put]
            wait = wait[~(free & first)]
            slot[wait] += 1
            if len(wait) and slot[wait].max() >= len(self.slots) - 1:
                raise RuntimeError("the table of transitions is too full")

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(self.shift)).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states that ``code`` leads to; 0 where it leads nowhere."""
        key = state * self.width + code
        if self.dense is not None:
            return self.dense[key]
        slot = self._slot(key)
        at = self.slots[slot]
        out = np.where(at == key, self.to[slot], 0)
        todo = np.nonzero((at != key) & (at >= 0))
        while len(todo[0]):
            slot[todo] += 1
            at = self.slots[slot[todo]]
            hit = at == key[todo]
            out[tuple(i[hit] for i in todo)] = self.to[slot[tuple(i[hit] for i in todo)]]
            more = ~hit & (at >= 0)
            todo = tuple(i[more] for i in todo)
        return out

    def alphabet(self) -> Alphabet:
        return Alphabet(self.known)


def _parse(model: Model, chunks: list[np.ndarray], warm: np.ndarray, state: np.ndarray):
    """Phrases and literals that end in each chunk after its ``warm`` letters, and the states there and at its end.

    One row a chunk, one column a language; each chunk begins in its ``state``.
    """
    order = np.argsort([-len(c) for c in chunks], kind="stable")
    lens = np.array([len(chunks[i]) for i in order])
    grid = np.zeros((len(chunks), int(lens[0]) if len(lens) else 0), np.int32)
    for r, i in enumerate(order):
        grid[r, : len(chunks[i])] = chunks[i]
    roots = np.array(model.roots, np.int64)[None, :]
    first = model.step(np.repeat(roots, model.width, 0), np.arange(model.width)[:, None])  # from the root, by code
    state, warm = state[order].astype(np.int64), warm[order]
    count, literal, begun = np.zeros(state.shape, np.int64), np.zeros(state.shape, np.int64), state.copy()
    active = np.searchsorted(-lens, -np.arange(grid.shape[1]), side="left")
    for j in range(grid.shape[1]):
        k = active[j]
        if j == WARM:
            rows = np.flatnonzero(warm[:k] == j)
            begun[rows], count[rows], literal[rows] = state[rows], 0, 0
        c = grid[:k, j, None]
        to = model.step(state[:k], c)
        missed = to == 0
        if missed.any():
            again = first[grid[:k, j]]
            alone = missed & (again == 0)  # a letter unknown to the language is a phrase of its own
            count[:k] += missed & (state[:k] != roots)
            literal[:k] += alone
            to = np.where(missed, np.where(alone, roots, again), to)
        state[:k] = to
    out = []
    for x in (count, literal, begun, state):
        back = np.empty_like(x)
        back[order] = x
        out.append(back)
    return out


def phrases(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and literals that each language needs for each text: one row a text, one column a language.

    A long text's pieces are parsed side by side. A piece that was not in the state in which the one
    before it ended is parsed again from there, so the counts are those of one parse of the whole text.
    """
    roots = np.array(model.roots, np.int64)
    total = np.zeros((2, len(texts), len(roots)), np.int64)
    carried = roots[None, :]
    parts = [(i, at) for i, t in enumerate(texts) for at in range(0, len(t), CHUNK)]
    for low in range(0, len(parts), _LANES):
        some = parts[low : low + _LANES]
        warm = np.array([WARM if at else 0 for _, at in some])
        chunks = [texts[i][at - w : at + CHUNK] for (i, at), w in zip(some, warm, strict=True)]
        count, literal, begun, ended = _parse(model, chunks, warm, np.tile(roots, (len(some), 1)))
        later = np.array([at > 0 for _, at in some])
        while True:
            before = np.concatenate([carried, ended[:-1]])
            late = np.flatnonzero(later & (begun != before).any(1))
            if not len(late):
                break
            again = _parse(model, [texts[some[r][0]][some[r][1] : some[r][1] + CHUNK] for r in late], np.zeros(len(late), np.int64), before[late])
            count[late], literal[late], _, ended[late] = again
            begun[late] = before[late]
        last = [r for r, (i, at) in enumerate(some) if at + CHUNK >= len(texts[i])]
        count[last] += ended[last] != roots
        carried = ended[-1:]
        np.add.at(total, (slice(None), [i for i, _ in some]), np.stack([count, literal]))
    return total[0], total[1]


def identify(model: Model, alphabet: Alphabet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text; ``und`` and 0 where there is no letter."""
    langs, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
    if not model.langs:
        return langs, scores
    coded = {i: c for i, t in enumerate(texts) if t and (c := alphabet.codes(t)).any()}
    count, literal = phrases(model, list(coded.values()))
    bits = np.array(model.bits)
    for r, (i, codes) in enumerate(coded.items()):
        n = len(codes)
        cost = (count[r] * bits + literal[r] * LITERAL) / n
        best = int(np.argmin(cost))
        # A softmax over the total bits, tempered so that long texts don't all saturate.
        gap = (cost - cost[best]) * min(n, 64)
        langs[i], scores[i] = model.langs[best], float(1 / np.exp2(-np.minimum(gap, 1000)).sum())
    return langs, scores


def held_out(doc_id: Column, of: int = 4, part: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of == part


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on ``labelled(text, lang)``, at most ``sample_chars`` characters per language.

    The rows sampled are those whose text hash falls below a bar set from each language's total, so
    only a few times ``sample_chars`` characters per language come to the driver.
    """
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    totals = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count("*").alias("docs"))
    bar = totals.select(F.col("lang").alias("l"), (F.greatest(F.lit(6.0 * sample_chars) / F.col("n"), F.lit(48.0) / F.col("docs")) * (1 << 40)).alias("bar"))
    few = rows.join(F.broadcast(bar), F.col("lang") == F.col("l")).filter("h < bar").groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    samples: dict[str, str] = {}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["h"])):
        got = samples.get(r["lang"], "")
        if len(got) < sample_chars:
            samples[r["lang"]] = (got + " " + r["text"])[:sample_chars]
    return Model(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred string, score double``, from ``text`` alone.

    Null texts and texts without a letter give ``und`` and 0. Whole texts are parsed. Other columns pass through (those two names are replaced); repeated rows
    give repeated rows; a model without languages gives ``und`` for all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        alphabet = m.alphabet()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                langs, scores = identify(m, alphabet, b.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, "lang_pred", "score"])

    kept = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    return kept.mapInArrow(run, kept.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)


def fit_on_documents(docs: DataFrame, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on the rows with a language whose doc_id is not held out; a null doc_id is left out too."""
    return fit(docs.filter(~held_out(F.col("doc_id"))), sample_chars)
