"""Personal data spans by weak supervision, in DataFrame and SQL functions only.

Labelers (pattern validators, gazetteers, context words, boundaries, variety of characters) vote on
candidate spans. Expectation-maximisation over the counts of vote patterns estimates how reliable
each labeler is; a logistic span classifier is then fitted to the posteriors. Texts never leave the
JVM; the driver sees the table of vote patterns, whose size is bounded by the votes' alphabet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm._runtime import stage, unused

# Base kinds in their order. Possessive repeats keep Java's matcher from recursing on long runs, and
# \G or a look-behind starts a match only where an earlier start in the same run was not tried.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind to be looked for.
HINT = {"email": "@", "phone": "+"}
GIVEN_NAMES = "Anna|Maria|John|James|Mary|Robert|Michael|Linda|David|Susan|Thomas|Peter|Hans|Klaus|Ursula|Jürgen|Sabine|Wolfgang|Pierre|Jean|Marie|Nathalie|Michel|Claire|José|Juan|Carmen|Pilar|Javier|Lucía|Carlos|Ana"
ADDED = {
    "spelled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+\x20?(?:\(dot\)|\[dot\]|\.)\x20?[A-Za-z]{2,10}+",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": rf"(?<![\p{{L}}])(?:{GIVEN_NAMES})\x20\p{{Lu}}\p{{Ll}}{{2,20}}(?![\p{{L}}])",
}
ADDED_HINT = {"spelled_email": "at", "local_phone": None, "national_id": "-", "iban": None, "name": None}
CONTEXT = r"(?i)(?:e-?mail|mail|courriel|correo|contact|kontakt|contacto|tel|phone|call|fon|mobile|handy|card|karte|carte|tarjeta|visa|server|host|address|adresse|dirección|ip|name|nom|nombre|iban|konto|ssn|passport)\W{0,4}(?:\w{0,8}\W{1,3})?$"
TOP_DOMAINS = "com|org|net|edu|gov|de|fr|es|uk|io|eu|info"
VOTES = ("valid", "gazetteer", "context", "bounded", "varied")
KINDS = (*BASE, *ADDED)


def _located(text: Column, pattern: str) -> Column:
    """``array<struct<a,z,hit>>`` of a pattern's matches; code points, end exclusive."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    none = F.array().cast("array<struct<a:int,z:int,hit:string>>")

    def step(acc, x):
        a = acc["at"] + F.length(x["gap"])
        z = a + F.length(x["hit"])
        return F.when(x["hit"].isNull(), acc).otherwise(F.struct(z.alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("a"), z.alias("z"), x["hit"].alias("hit")))).alias("out")))

    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(hit: Column) -> Column:
    r = F.reverse(_digits(hit))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(r), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(r, i, F.lit(1)).cast("int").alias("d")))
    total = F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x["i"] % 2 == 1, x["d"]).when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2))
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    """The base rule of a kind; the added kinds have none of their own."""
    n = F.length(_digits(hit))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(hit)).otherwise(False)
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def _votes(kind: str, text: Column, x: Column) -> Column:
    """The labelers' votes on one candidate: 1 yes, -1 no, 0 abstain."""
    hit, a, z = x["hit"], x["a"], x["z"]
    left = F.substring(text, F.greatest(F.lit(1), a - 31), F.least(F.lit(32), a))
    beside = F.concat(F.substring(text, a, F.when(a > 0, F.lit(1)).otherwise(F.lit(0))), F.lit(" "), F.substring(text, z + 1, F.lit(1)))
    digits = _digits(hit)
    never = F.lit(False)
    gazetteer = {
        "email": _vote(F.lower(hit).rlike(rf"\.(?:{TOP_DOMAINS})$"), F.length(hit) > 254),
        "ip": _vote(~hit.rlike(r"^(?:0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), hit.rlike(r"^0+\.")),
        "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[0189]")),
        "phone": _vote(digits.rlike("^(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), digits.rlike("^0")),
        "local_phone": _vote(~digits.rlike("^[01]"), digits.rlike("^[01]")),
        "national_id": _vote(~digits.rlike("^(?:000|666|9)"), digits.rlike("^(?:000|666|9)|0000$")),
        "iban": _vote(hit.rlike("^(?:DE|FR|ES|GB|IT|NL|BE|AT|CH|PT|IE)"), never),
        "name": _vote(F.lit(True), never),
    }.get(kind, _vote(F.lower(hit).rlike(rf"(?:{TOP_DOMAINS})$"), never))
    letters = F.size(F.array_distinct(F.split(F.when(F.length(digits) >= 7, digits).otherwise(hit), "")))
    return F.array(
        _vote(_valid(kind, hit), ~_valid(kind, hit)) if kind in ("ip", "card", "phone") else _vote(F.lit(True), never),
        gazetteer,
        _vote(left.rlike(CONTEXT), never),
        _vote(~beside.rlike(r"[\p{L}\p{N}]"), beside.rlike(r"[\p{L}\p{N}]")),
        _vote(letters >= 4, letters <= 2),
    )


def _candidate(text: Column, kind: str, rank: int):
    return lambda x: F.struct(
        x["a"], F.lit(rank).alias("rank"), x["z"], F.lit(kind).alias("kind"), _valid(kind, x["hit"]).alias("ok"), F.lit(kind in BASE).alias("base"), _votes(kind, text, x).alias("votes")
    )


def _candidates(text: Column) -> Column:
    """``array<struct<a,rank,z,kind,ok,base,votes>>`` of a text, by start and then kind."""
    none = F.array().cast("array<struct<a:int,rank:int,z:int,kind:string,ok:boolean,base:boolean,votes:array<tinyint>>>")
    out = []
    for rank, kind in enumerate(KINDS):
        pattern, hint = (BASE[kind], HINT.get(kind)) if kind in BASE else (ADDED[kind], ADDED_HINT[kind])
        found = F.transform(_located(text, pattern), _candidate(text, kind, rank))
        there = text.contains(hint) if hint else text.rlike(pattern if kind not in BASE else "[0-9][.\\x20-]?[0-9]")
        out.append(F.when(there, found).otherwise(none))
    # A run of digits too short or long for a card says nothing about cards; it is no candidate.
    return F.array_sort(F.filter(F.concat(*out), lambda c: ~(c["kind"] == "card") | c["ok"] | (c["z"] - c["a"]).between(12, 40)))


def with_candidates(docs: DataFrame, name: str = "candidates") -> DataFrame:
    """``docs`` with the column ``candidates``, or one of another ``name``; a null text counts as empty."""
    return docs.withColumn(name, _candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))))


@dataclass
class Model:
    """A logistic classifier of candidate spans: weights of kinds and of the labelers' votes."""

    bias: dict[str, float]
    weight: dict[tuple[str, int], float]
    reliability: dict[str, dict[int, tuple[float, float]]]


def fit(marked: DataFrame, rounds: int = 50, steps: int = 300) -> Model:
    """Fit on the vote patterns of ``marked(candidates)``.

    The pattern counts (at most kinds x 3^labelers rows) are the only thing collected.
    """
    patterns = marked.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()
    table = sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in patterns)
    prior = {k: 0.7 for k in KINDS}
    # The start: each labeler is right more often than not.
    rel = {v: {1: (0.7, 0.3), 0: (0.2, 0.3), -1: (0.1, 0.4)} for v in VOTES}
    post: list[float] = []
    for _ in range(rounds if table else 0):
        post = []
        for kind, votes, _n in table:
            yes, no = math.log(prior[kind]), math.log(1 - prior[kind])
            for v, x in zip(VOTES, votes, strict=True):
                yes, no = yes + math.log(rel[v][x][0]), no + math.log(rel[v][x][1])
            post.append(1 / (1 + math.exp(max(-500.0, min(500.0, no - yes)))))
        for kind in KINDS:
            own = [(p, n) for (k, _, n), p in zip(table, post, strict=True) if k == kind]
            prior[kind] = min(0.98, max(0.02, (sum(p * n for p, n in own) + 7) / (sum(n for _, n in own) + 10)))
        for i, v in enumerate(VOTES):
            counts = {x: [1.0 + 2 * rel[v][x][0], 1.0 + 2 * rel[v][x][1]] for x in (1, 0, -1)}
            for (_, votes, n), p in zip(table, post, strict=True):
                counts[votes[i]][0] += p * n
                counts[votes[i]][1] += (1 - p) * n
            total = [sum(c[j] for c in counts.values()) for j in (0, 1)]
            rel[v] = {x: (c[0] / total[0], c[1] / total[1]) for x, c in counts.items()}
    bias = {k: math.log(prior[k] / (1 - prior[k])) for k in KINDS}
    weight = {(v, x): math.log(rel[v][x][0] / rel[v][x][1]) for v in VOTES for x in (1, 0, -1)}
    total = sum(n for *_, n in table) or 1
    for _ in range(steps if table else 0):  # logistic regression on the posteriors, from the generative start
        grad_b, grad_w = dict.fromkeys(KINDS, 0.0), dict.fromkeys(weight, 0.0)
        for (kind, votes, n), p in zip(table, post, strict=True):
            s = bias[kind] + sum(weight[v, x] for v, x in zip(VOTES, votes, strict=True))
            e = (1 / (1 + math.exp(max(-500.0, min(500.0, -s)))) - p) * n / total
            grad_b[kind] += e
            for v, x in zip(VOTES, votes, strict=True):
                grad_w[v, x] += e
        for k in bias:
            bias[k] -= 0.5 * (grad_b[k] + 1e-4 * bias[k])
        for k in weight:
            weight[k] -= 0.5 * (grad_w[k] + 1e-4 * weight[k])
    return Model(bias, weight, rel)


def _score(model: Model, c: Column) -> Column:
    s = F.coalesce(*[F.when(c["kind"] == k, F.lit(b)) for k, b in model.bias.items()])
    for i, v in enumerate(VOTES):
        x = c["votes"][i]
        s = s + F.when(x == 1, F.lit(model.weight[v, 1])).when(x == 0, F.lit(model.weight[v, 0])).otherwise(F.lit(model.weight[v, -1]))
    return 1 / (1 + F.exp(-s))


def _spans(candidates: Column, model: Model) -> tuple[Column, Column]:
    """The base matches among the candidates, and these with what the classifier adds.

    Added spans of at least one half that overlap no base span are taken; base spans stay whatever
    their score. Both are ``array<struct<a,rank,z,kind>>`` by start and then kind.
    """
    slim = lambda c: F.struct(c["a"], c["rank"], c["z"], c["kind"])
    base = F.transform(F.filter(candidates, lambda c: c["base"] & c["ok"]), slim)
    added = F.transform(F.filter(candidates, lambda c: ~c["base"] & (_score(model, c) >= 0.5)), slim)
    free = F.filter(added, lambda c: ~F.exists(base, lambda b: (b["a"] < c["z"]) & (c["a"] < b["z"])))
    return base, F.array_sort(F.concat(base, free))


def with_spans(marked: DataFrame, model: Model) -> DataFrame:
    """``marked`` with ``base`` and ``spans`` in place of ``candidates``; columns of these two names are replaced."""
    base, spans = _spans(F.col("candidates"), model)
    return marked.withColumns({"base": base, "spans": spans}).drop("candidates")


def written(spans: Column | str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["z"].cast("string"))), ",")


def count(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` for every row of ``docs(doc_id, text)``.

    Null and empty texts have no spans; other columns are ignored; repeated rows give repeated rows;
    an empty table gives no rows. Candidates (without texts) are staged once, fitted on, then scored.
    """
    marked = stage(with_candidates(docs.select("doc_id", "text")).select("doc_id", "candidates"), "pii")
    return with_spans(marked, fit(marked))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in brackets; other columns as they are, whatever their names.

    Overlapping spans are replaced together, under the first one's kind. A null text stays null. The rows
    are staged once with their candidates.
    """
    found, spans = unused(docs, "candidates", "spans")
    marked = stage(with_candidates(docs, found), "pii")
    model = fit(marked.select(F.col(found).alias("candidates")))
    marked = marked.withColumn(spans, _spans(F.col(found), model)[1])
    text = F.col("text").cast("string")
    # Where each span begins to count: after all spans before it. One that lies within those is left out.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,z:int,kind:string>>").alias("out"))

    def step(acc, s):
        more = F.array_append(acc["out"], F.struct(s["a"].alias("a"), s["z"].alias("z"), s["kind"].alias("kind")))
        longer = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(F.element_at(acc["out"], -1)["a"].alias("a"), s["z"].alias("z"), F.element_at(acc["out"], -1)["kind"].alias("kind"))))
        return F.when(s["a"] >= acc["at"], F.struct(s["z"].alias("at"), more.alias("out"))).when(s["z"] > acc["at"], F.struct(s["z"].alias("at"), longer.alias("out"))).otherwise(acc)

    merged = F.aggregate(spans, start, step, lambda acc: acc["out"])

    def replaced(ms):
        before = lambda i: F.when(i > 0, F.get(ms, i - 1)["z"]).otherwise(0)
        parts = F.transform(ms, lambda m, i: F.concat(F.substring(text, before(i) + 1, m["a"] - before(i)), F.lit("["), F.upper(m["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(ms, -1)["z"] + 1, F.length(text)))

    done = F.element_at(F.transform(F.array(merged), replaced), 1)
    return marked.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
