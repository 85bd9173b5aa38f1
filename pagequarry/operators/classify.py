"""Page classification from URL rules, keywords and structured-data types, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry.functions.rules import DATA_TYPES, KEYWORDS, URL_RULES


def url_score(path: Column, kind: str) -> Column:
    return F.when(F.lower(path).rlike("|".join(f"(?:{r})" for r in URL_RULES[kind])), 1.0).otherwise(0.0)


def keyword_score(text: Column, kind: str) -> Column:
    """Weighted shares of the kind's strong and medium keywords that ``text`` (lower case) holds."""
    if kind not in KEYWORDS:
        return F.lit(0.0)
    share = []
    for keys in KEYWORDS[kind]:
        share.append(reduce(lambda a, b: a + b, [text.contains(k).cast("int") for k in keys]).cast("double") / float(len(keys)))
    return F.least(share[0] * 0.7 + share[1] * 0.3, F.lit(1.0))


def data_score(types: Column | None, kind: str) -> Column:
    """The share of the kind's structured-data types among ``types``; 0 without them."""
    if types is None or kind not in DATA_TYPES:
        return F.lit(0.0)
    want = F.array(*map(F.lit, DATA_TYPES[kind]))
    return F.coalesce(F.size(F.array_intersect(want, types)) / float(len(DATA_TYPES[kind])), F.lit(0.0))


def scores(path: Column, text: Column, types: Column | None = None) -> dict[str, Column]:
    return {k: url_score(path, k) * 0.4 + keyword_score(text, k) * 0.5 + data_score(types, k) * 0.1 for k in URL_RULES}


def page_type(scored: dict[str, Column]) -> Column:
    """``struct<page_type,confidence>``: the best type (the first of equals) and its band."""
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scored.items())]))
    s = best["s"]
    band = F.when(s < 0.1, 0.0).when(s < 0.3, 0.3).when(s < 0.5, 0.6).when(s < 0.7, 0.8).otherwise(0.95)
    return F.struct(F.when(s < 0.1, "unknown").otherwise(best["k"]).alias("page_type"), band.alias("confidence"))
