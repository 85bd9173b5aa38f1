"""A trained tagger of named entities: an averaged perceptron over tokens, decoded by Viterbi.

No labelled texts come with the library, so it is taught by the rules: what the entity patterns find in a sample of sentences
are its labels. It then goes by words, shapes and neighbours, and so also finds names that no pattern spells out.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagequarry.functions.rules import ENTITY_PATTERNS, HINTS, NAMED_FIELD_BONUS
from pagequarry.functions.text import clean
from pagequarry.sources.tables import unused

# The entity type that each label stands for.
LABELS = {"ORG": "brand", "PRODUCT": "product", "MONEY": "price", "GPE": "location", "LOC": "location", "PERSON": "brand", "WORK_OF_ART": "product", "EVENT": "service"}
#: The label that a type's patterns teach. Persons, places without a state and works have no pattern, so they are not taught.
TAUGHT = {"brand": "ORG", "product": "PRODUCT", "price": "MONEY", "location": "GPE", "service": "EVENT"}
TAGS = ["O", *[f"{b}-{x}" for x in TAUGHT.values() for b in "BI"]]
#: Sentences that a model is fitted on at most, half of them with a hint of an entity, and rounds over them.
MAX_TRAIN, EPOCHS = 4000, 6
#: Characters of a sentence that is learned from, at most; tokens decoded together; tokens of context on either side.
LONGEST, TOGETHER, AROUND = 400, 400, 10
_TOKEN = re.compile(r"\w+|[^\w\s]")
_END = re.compile(r"[.!?\n]\s+|\n")
_AT = {t: i for i, t in enumerate(TAGS)}
#: What may follow what: an inner tag only its own label.
_MAY = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] else -1e9 for b in TAGS] for a in TAGS])


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def features(ws: list[str]) -> list[list[str]]:
    """Each token's features: itself, its ending and shape, its neighbours."""
    shape = [re.sub(r"\d+", "9", re.sub(r"[^\W\d_A-Z]+", "a", re.sub("[A-Z]", "A", w)))[:6] for w in ws]
    low = ["", "", *[w.lower() for w in ws], "", ""]
    out = []
    for i, w in enumerate(ws):
        a, b, me, c, d = low[i : i + 5]
        out.append(["bias", f"w={me}", f"e={me[-4:]}", f"s={shape[i]}", f"p={b}", f"n={c}", f"pp={a}|{b}", f"nn={c}|{d}", f"pw={b}|{me}", f"wn={me}|{c}", f"ss={shape[i - 1] if i else ''}|{shape[i]}|{shape[i + 1] if i + 1 < len(ws) else ''}", f"first={i == 0}"])
    return out


@dataclass
class Model:
    """Weights of each feature for each tag, and of each tag after another."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((len(TAGS), len(TAGS))))

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The best allowed sequence of tags."""
        none = np.zeros(len(TAGS))
        get, moves = self.weights.get, self.moves + _MAY
        score, back = None, []
        for fs in feats:
            own = sum((get(f, none) for f in fs), none)
            if score is None:
                score = own + _MAY[0]
            else:
                both = score[:, None] + moves
                back.append(both.argmax(0))
                score = both.max(0) + own
        if score is None:
            return []
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def spans(self, text: str) -> list[tuple[str, int, str, str]]:
        """``(label, start, value, context)`` of a text's entities, sentence by sentence."""
        return next(Table(self).spans([text]))


def segments(text: str, at: list[tuple[int, int]]) -> list[int]:
    """Where the sentences of a text's tokens begin; those over TOGETHER tokens are cut."""
    starts, ends = [a for a, _ in at], [m.start() + 1 for m in _END.finditer(text)]
    out, begin = [], 0
    while begin < len(at):
        out.append(begin)
        e = bisect_right(ends, starts[begin])
        stop = bisect_left(starts, ends[e], begin + 1) if e < len(ends) else len(at)
        begin = min(stop, begin + TOGETHER)
    return out


class Table:
    """A model's weights as one table of rows, for many sentences at once; it gives what ``decode`` gives, sums being added in the same order."""

    #: Tokens that are decoded together, about.
    GROUP = 100_000

    def __init__(self, model: Model):
        self.moves = model.moves + _MAY
        self.at = {f: i for i, f in enumerate(model.weights, 1)}
        self.rows = np.vstack([np.zeros(len(TAGS)), *model.weights.values()])
        self.words, self.shapes = {"": 0}, {"": 0}
        found: dict[str, list[tuple[tuple[int, ...], int]]] = {k: [] for k in ("pp", "nn", "pw", "wn", "ss")}
        for f, row in self.at.items():
            kind, _, body = f.partition("=")
            if kind in found:
                # A token may be a bar itself, so every bar may be the one between the parts.
                known, bars = (self.shapes, 2) if kind == "ss" else (self.words, 1)
                for cut in combinations([i for i, c in enumerate(body) if c == "|"], bars):
                    parts = [body[i + 1 : j] for i, j in zip((-1, *cut), (*cut, len(body)), strict=True)]
                    found[kind].append((tuple(known.setdefault(x, len(known)) for x in parts), row))
        self.joint = {}
        for kind, hits in found.items():
            base = len(self.shapes if kind == "ss" else self.words) + 1
            codes = np.array([reduce(lambda n, x: n * base + x, ids, 0) for ids, _ in hits], np.int64)
            order = np.argsort(codes)
            self.joint[kind] = base, np.append(codes[order], -1), np.append(np.array([r for _, r in hits], np.int64)[order], 0)

    def _rows_of(self, kind: str, *ids: np.ndarray) -> np.ndarray:
        base, codes, rows = self.joint[kind]
        code = reduce(lambda n, x: n * base + x, ids)
        slot = np.searchsorted(codes[:-1], code)
        return np.where(codes[slot] == code, rows[slot], 0)

    def scores(self, ws: list[str], begins: np.ndarray) -> np.ndarray:
        """Each token's score for each tag, of sentences one after the other."""
        get, known = self.at.get, {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in ws), np.int64, len(ws))
        each = []
        for w in known:
            me, shape = w.lower(), re.sub(r"\d+", "9", re.sub(r"[^\W\d_A-Z]+", "a", re.sub("[A-Z]", "A", w)))[:6]
            each.append((get(f"w={me}", 0), get(f"e={me[-4:]}", 0), get(f"s={shape}", 0), get(f"p={me}", 0), get(f"n={me}", 0), self.words.get(me, len(self.words)), self.shapes.get(shape, len(self.shapes))))
        own, ending, shape_row, as_before, as_next, word, shape = np.array(each, np.int64).T[:, ids]
        first = np.zeros(len(ws), bool)
        first[begins] = True
        last = np.append(first[1:], True)

        def before(x, none):
            return np.where(first, none, np.append(none, x[:-1]))

        def after(x, none):
            return np.where(last, none, np.append(x[1:], none))

        b, c = before(word, 0), after(word, 0)
        out = np.repeat(self.rows[get("bias", 0)][None, :], len(ws), 0)
        for rows in (
            own, ending, shape_row, before(as_before, get("p=", 0)), after(as_next, get("n=", 0)), self._rows_of("pp", before(b, 0), b), self._rows_of("nn", c, after(c, 0)), self._rows_of("pw", b, word), self._rows_of("wn", word, c),
            self._rows_of("ss", before(shape, 0), shape, after(shape, 0)), np.where(first, get("first=True", 0), get("first=False", 0)),
        ):
            out += self.rows[rows]
        return out

    def decode(self, ws: list[str], begins: list[int]) -> np.ndarray:
        """The best allowed tags of all sentences' tokens."""
        start = np.array(begins, np.int64)
        own, size = self.scores(ws, start), np.diff(np.append(start, len(ws)))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # sentences of more tokens than that
        score, back = own[start] + _MAY[0], np.zeros((len(ws), len(TAGS)), np.int8)
        for j in range(1, size[0]):
            k = active[j]
            s, at = score[:k], start[:k] + j
            best, arg = s[:, :1] + self.moves[0], np.zeros((k, len(TAGS)), np.int8)
            for a in range(1, len(TAGS)):
                one = s[:, a : a + 1] + self.moves[a]
                np.putmask(arg, one > best, a)
                np.maximum(best, one, out=best)
            back[at] = arg
            score[:k] = best + own[at]
        tags, now = np.zeros(len(ws), np.int64), score.argmax(1)
        for j in range(size[0] - 1, -1, -1):
            at = start[: active[j]] + j
            tags[at] = now[: len(at)]
            now[: len(at)] = back[at, now[: len(at)]]
        return tags

    def spans(self, texts: Iterable[str | None]) -> Iterator[list[tuple[str, int, str, str]]]:
        """Of each text what ``Model.spans`` says of one."""
        some, ws, begins = [], [], []
        for text in texts:
            at = tokens(text) if text else []
            begins += [len(ws) + i for i in segments(text, at)] if at else []
            some.append((text, at, len(ws)))
            ws += [text[a:b] for a, b in at]
            if len(ws) >= self.GROUP:
                yield from self._found(some, ws, begins)
                some, ws, begins = [], [], []
        yield from self._found(some, ws, begins)

    def _found(self, some: list, ws: list[str], begins: list[int]) -> Iterator[list[tuple[str, int, str, str]]]:
        tags = self.decode(ws, begins) if ws else np.zeros(0, np.int64)
        heads = set(begins)
        for text, at, low in some:
            out, free = [], 0
            for i in np.flatnonzero(tags[low : low + len(at)]).tolist():
                if i < free:
                    continue
                label, j = TAGS[tags[low + i]][2:], i + 1
                while j < len(at) and low + j not in heads and TAGS[tags[low + j]] == f"I-{label}":
                    j += 1
                near = at[max(0, i - AROUND) : j + AROUND]
                out.append((label, at[i][0], text[at[i][0] : at[j - 1][1]], " ".join(text[x:y] for x, y in near)))
                free = j
            yield out


def taught(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, label)`` of what the patterns find, without overlaps: the first, of those the longest."""
    low, found = text.lower(), []
    for kind, label in TAUGHT.items():
        for (pattern, _), hints in zip(ENTITY_PATTERNS[kind], HINTS[kind], strict=True):
            if any(h in low for h in hints):
                found += [(m.start(), -m.end(), label) for m in re.finditer(pattern, text, re.IGNORECASE)]
    out, free = [], 0
    for start, end, label in sorted(found):
        if start >= free:
            out.append((start, -end, label))
            free = -end
    return out


def tagged(text: str) -> tuple[list[list[str]], list[int]]:
    """A sentence's features and taught tags."""
    at, tags, last = tokens(text), [], None
    found = taught(text)
    for a, b in at:
        hit = next((f for f in found if f[0] <= a and b <= f[1]), None)
        tags.append(0 if hit is None else _AT[f"{'I' if hit == last else 'B'}-{hit[2]}"])
        last = hit
    return features([text[a:b] for a, b in at]), tags


def learn(sentences: list[str], epochs: int = EPOCHS, seed: int = 1) -> Model:
    """A perceptron whose weights are averaged over all steps; the sentences come in a new order each round."""
    data = [x for x in map(tagged, sentences) if x[1]]
    model, rng, step = Model(), random.Random(seed), 1
    total: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(TAGS)))
    moved = np.zeros_like(model.moves)
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, want in data:
            got = model.decode(feats)
            if got != want:
                for i, (fs, g, w) in enumerate(zip(feats, got, want, strict=True)):
                    if g != w:
                        for f in fs:
                            own = model.weights.setdefault(f, np.zeros(len(TAGS)))
                            own[w] += 1
                            own[g] -= 1
                            total[f][w] += step
                            total[f][g] -= step
                    if i and (got[i - 1], g) != (want[i - 1], w):
                        for a, b, sign in ((want[i - 1], w, 1), (got[i - 1], g, -1)):
                            model.moves[a, b] += sign
                            moved[a, b] += sign * step
            step += 1
    return Model({f: w - total[f] / step for f, w in model.weights.items()}, model.moves - moved / step)


def fit(df: DataFrame, column: str = "text", most: int = MAX_TRAIN, epochs: int = EPOCHS) -> Model:
    """A model taught on up to ``most`` different sentences of ``df``, which come by the least hashes; half of them hold a hint where there are so many."""
    lines = df.select(F.explode(F.split(F.col(column).cast("string"), r"(?<=[.!?])\s+|\n")).alias("s")).filter(F.length("s").between(3, LONGEST))
    chars = df.agg(F.sum(F.octet_length(F.col(column).cast("string")))).first()[0] or 0
    hinted = F.lower("s").rlike("|".join(re.escape(h) for k in TAUGHT for hs in HINTS[k] for h in hs if len(h) > 2) + r"|[$%®™@]")
    lines = lines.select("s", hinted.alias("hinted"), F.xxhash64("s").alias("h"))
    some = [s for with_ in (True, False) for s in _least(lines, with_, most // 2, chars)]
    return learn(some, epochs)


#: Sentences are taken to have so many characters at least when it is guessed how many there are.
SENTENCE = 20


def _least(lines: DataFrame, hinted: bool, most: int, chars: int) -> list[str]:
    """The ``most`` different sentences of the least hashes of ``lines(s, h, hinted)``, from texts of so many characters in all.

    Only sentences of hashes below a bar are told apart and sorted. If they are too few, the bar is raised, at last over all of them.
    """
    share = 4.0 * most * SENTENCE / max(1, chars)
    while True:
        low = lines if share >= 1 else lines.filter(F.col("h") < int(-(2**63) + share * 2**64))
        found = low.filter(F.col("hinted") == hinted).select("h", "s").distinct().orderBy("h", "s").limit(most).collect()
        if len(found) == most or share >= 1:
            return [r["s"] for r in found]
        share *= 16


class _Shared:
    """A model whose table is made once a task, where it is used."""

    def __init__(self, model: Model):
        self.model = model

    @cached_property
    def table(self) -> Table:
        return Table(self.model)


_SPANS = ArrayType(StructType([StructField("label", StringType()), StructField("start", IntegerType()), StructField("value", StringType()), StructField("context", StringType())]))


def named(df: DataFrame, model: Model, column: str = "text", field: str = "content_text", least: float = 0.5) -> DataFrame:
    """One row per entity that the tagger finds in the cleaned text: label, entity_type, start, value, confidence, context, which replace columns of these names.

    Confidence starts at 0.7 and grows with the field, with several words and with a capital at the start. Null and blank texts give no rows.
    """

    shared = _Shared(model)

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.table.spans(texts)), texts.index, object)

    gone = {column, "label", "entity_type", "start", "value", "confidence", "context"}
    keep, (one,) = [c for c in df.columns if c.lower() not in gone], unused(df, "entity")
    rows = df.select(*keep, F.explode(spans(clean(F.col(column)))).alias(one)).select(*keep, f"{one}.*")
    kind = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("label")]
    sure = F.lit(0.7 + NAMED_FIELD_BONUS.get(field, 0.0)) + F.when(F.rlike("value", F.lit(r"\S\s+\S")), 0.1).otherwise(0.0) + F.when(F.rlike("value", F.lit(r"^\p{Lu}")), 0.1).otherwise(0.0)
    return rows.withColumns({"entity_type": kind, "confidence": F.least(sure, F.lit(1.0))}).filter(F.col("confidence") >= least).select(*keep, "label", "entity_type", "start", "value", "confidence", "context")
