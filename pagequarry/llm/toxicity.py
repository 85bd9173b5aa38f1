"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of a learned lexicon (as written and with disguises undone), how close its
words stand to second-person pronouns, and rates of capitals, punctuation and obfuscation. They come
from the text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import cut

MAX_TRAIN, MAX_LEXICON = 12_000, 1_000
STRONG = 1.5
NEAR = 6
_MEMO = 200_000
# Second-person pronouns of English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen deiner euch euer ihr tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti contigo tuyo tuya".split())
_UNDISGUISE = str.maketrans("013457@$!|", "oieastasil")
NAMES = ("strong_rate", "strong_any", "strong_distinct", "weight_mean", "weight_sum", "disguised_rate", "near_second_person", "second_person_rate", "capitals", "all_caps_words", "exclamations", "questions", "other_marks", "obfuscated_words", "marked_words", "log_words")


def normalise(token: str) -> tuple[str, str]:
    """A token's letters in lower case, and the same with look-alike signs read as letters."""
    low = token.lower()
    return "".join(filter(str.isalpha, low)), "".join(filter(str.isalpha, low.strip("!|$@.,?;:").translate(_UNDISGUISE)))


class Features:
    """Dense features of a text under a lexicon of word weights."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.memo = _Tokens(self)

    def token(self, token: str) -> tuple[int, float]:
        plain, clear = normalise(token)
        w, v = self.lexicon.get(plain, 0.0), self.lexicon.get(clear, 0.0)
        core = token.strip(".,;:!?\"'()")
        flags = (
            (max(w, v) >= STRONG)
            | (plain in SECOND_PERSON) << 1
            | (len(plain) > 1 and token.upper() == token and token.lower() != token) << 2
            | (v >= STRONG > w) << 3
            | bool(plain and not core.isalpha() and core[:1].isalpha() and core[-1:].isalpha()) << 4
            | bool(plain and core != plain and not core[-1:].isalnum()) << 5
            | min(255, sum(map(str.isupper, token))) << 8
            | min(255, len(plain)) << 16
        )
        return flags, max(w, v)

    def of(self, text: str | None) -> list[float]:
        tokens = (text or "").split()
        if not tokens:
            return [0.0] * len(NAMES)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        pairs = list(map(self.memo.__getitem__, tokens))
        flags = np.fromiter((p[0] for p in pairs), np.int64, len(pairs))
        weights = np.fromiter((p[1] for p in pairs), np.float64, len(pairs))
        n = len(pairs)
        strong, second = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
        near = 0
        if len(strong) and len(second):
            i = np.searchsorted(second, strong)
            right = np.where(i < len(second), second[np.minimum(i, len(second) - 1)] - strong, n)
            left = np.where(i > 0, strong - second[np.maximum(i - 1, 0)], n)
            near = int((np.minimum(left, right) <= NEAR).sum())
        letters = max(1, int((flags >> 16 & 255).sum()))
        marks = sum(text.count(c) for c in "*#%&$@_|")
        return [
            len(strong) / n * 100,
            float(min(len(strong), 20)),
            float(min(64, len({tokens[i].lower() for i in strong}))),
            float(weights.mean()),
            float(min(50.0, weights[strong].sum())),
            float((flags >> 3 & 1).sum()) / n * 100,
            near / n * 100,
            len(second) / n * 100,
            float((flags >> 8 & 255).sum()) / letters,
            float((flags >> 2 & 1).sum()) / n,
            text.count("!") / n,
            text.count("?") / n,
            marks / n,
            float((flags >> 4 & 1).sum()) / n,
            float((flags >> 5 & 1).sum()) / n,
            float(np.log1p(n)),
        ]


class _Tokens(dict):
    def __init__(self, features: Features):
        super().__init__()
        self.features = features

    def __missing__(self, token: str) -> tuple[int, float]:
        out = self.features.token(token)
        if len(token) < 64:
            self[token] = out
        return out


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` without its text and with ``features array<double>``."""

    def run(batches):
        features = Features(lexicon)
        for b in batches:
            got = pa.array([features.of(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            keep = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), got], [*keep, "features"])

    return docs.mapInArrow(run, docs.drop("text").select("*", F.array(F.lit(0.0)).alias("features")).schema)


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float


def sample_labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``(doc_id, text, toxic)`` of about ``most`` labelled documents outside the held-out fold.

    Labels are chosen by a hash of doc_id under a bar set from their number, so the side that is
    broadcast has about ``most`` rows at any size of the tables. Of several labels of one document
    the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")


def learn_lexicon(train: DataFrame, most: int = MAX_LEXICON) -> dict[str, float]:
    """Words that occur in a larger share of toxic than of other documents, with the log ratio."""
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\s]+", "")), r"\s+"))
    totals = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not totals.get(1) or not totals.get(0):
        return {}
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    weight = F.log(t / (totals[1] + 1)) - F.log(c / (totals[0] + 1))
    rows = (
        train.select("toxic", F.explode(words).alias("w"))
        .filter("w <> ''")
        .groupBy("w")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .filter("t >= 3")
        .select("w", weight.alias("weight"), (weight / F.sqrt(1 / t + 1 / c)).alias("z"))
        .filter("z > 3")
        .orderBy(F.desc("z"), "w")
        .limit(most)
    )
    return {r["w"]: round(r["weight"], 6) for r in rows.collect()}


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Lexicon and trees from folds 2 to 4, calibration from fold 1 of the sampled labels; fold 0 is never read."""
    train = cut(sample_labelled(docs, labels, most))
    rows = train.withColumn("toxic", F.when(F.col("toxic") > 0, 1).otherwise(0)).withColumn("fold", fold(F.col("doc_id")))
    learn = rows.filter("fold <> 1")
    lexicon = learn_lexicon(learn)
    seen = {r["toxic"]: r["n"] for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(seen.values())
    rate = seen.get(1, 0) / total if total else 0.0
    if not seen.get(0) or not seen.get(1):
        return Model(lexicon, None, None, rate)
    feats = cut(with_features(rows.select("doc_id", "text", "toxic", "fold"), lexicon).coalesce(8)).select(F.col("toxic").cast("double").alias("label"), "fold", array_to_vector("features").alias("features"))
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, seed=7, minInstancesPerNode=5).fit(feats.filter("fold <> 1").select("label", "features"))
    held = trees.transform(feats.filter("fold = 1")).select("label", vector_to_array("rawPrediction")[1].alias("margin"))
    calibration = None
    if held.groupBy("label").count().count() == 2:
        calibration = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="calibrated").fit(held)
    return Model(lexicon, trees, calibration, rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts are scored like any other, by their all-zero features. Repeated rows give
    repeated rows; other columns are ignored. A model fitted without both labels scores every row
    with the share of toxic labels it saw.
    """
    if model.trees is None:
        scored = docs.select("doc_id", F.lit(float(model.rate)).alias("score"))
    else:
        feats = with_features(docs.select("doc_id", F.col("text").cast("string").alias("text")), model.lexicon)
        out = model.trees.transform(feats.select("doc_id", array_to_vector("features").alias("features"))).select("doc_id", vector_to_array("probability")[1].alias("p"), vector_to_array("rawPrediction")[1].alias("margin"))
        if model.calibration is None:
            scored = out.select("doc_id", F.col("p").alias("score"))
        else:  # a trace of the trees' own probability orders the rows of one isotonic step
            scored = model.calibration.transform(out).select("doc_id", (F.col("calibrated") * 0.998 + F.col("p") * 0.002).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
