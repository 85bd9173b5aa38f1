"""Entities: extraction by pattern, merging, ranking, statistics, relations and deletion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagequarry.functions.rules import BASE_CONFIDENCE, ENTITY_PATTERNS, FIELD_BONUS, HINTS, NAME_ENDS, NAME_PHRASES, NAMED_FIELD_BONUS, NAMED_PRODUCT, PRICE_PHRASES, RULER, RULER_HINTS
from pagequarry.functions.text import _let, clean, folded, heading_text, normalize_value, similarity, strip, words
from pagequarry.operators import tagger
from pagequarry.sources.tables import settled, stored, unused

#: The fields of a page that are searched, in order.
FIELDS = ("title", "meta_description", "content_text", "headings")


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start,hit>>`` of a pattern's matches, from what lies between them.

    The text is searched once; what lies between the matches is looked for as far as the last of them only.
    It may be what a Python function gives, which Spark takes as a value but not within a lambda.
    """
    none = F.array().cast("array<struct<start:int,hit:string>>")

    def step(acc, x):
        at = acc["at"] + F.length(x["gap"])
        return F.struct((at + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), x["hit"].alias("hit")))).alias("out"))

    def placed(text, hits):
        gaps = F.slice(F.split(text, pattern, F.size(hits) + 1), 1, F.size(hits))
        pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
        return F.when(F.size(hits) == 0, none).otherwise(F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))

    return _let(text, lambda t: _let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda hits: placed(t, hits)))


def _kept(df: DataFrame, *gone: str) -> list[str]:
    """The columns of ``df`` that pass through: not those that are used up, nor those that are replaced, whatever their case."""
    return [c for c in df.columns if c.lower() not in {g.lower() for g in gone}]


def _found(text: Column, kind: str, number: int, pattern: str, confidence: float):
    around = lambda x: F.trim(F.substring(text, F.greatest(x["start"] - 49, F.lit(1)), F.least(x["start"], F.lit(50)) + F.length(x["hit"]) + 50))
    return lambda x: F.struct(
        F.lit(kind).alias("entity_type"), F.lit(number).alias("pattern"), x["start"].alias("start"), F.trim(x["hit"]).alias("value"), F.lit(min(confidence, 1.0)).alias("confidence"), around(x).alias("context")
    )


#: The end or start of a word of ASCII letters, digits and underscores, whatever the Java version.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _rule(pattern: str, ascii_words: bool) -> str:
    """A pattern that ignores case, with words, their ends and white space as in Unicode, or of ASCII only as SQL engines have them."""
    return "(?i)" + pattern.replace(r"\b", _EDGE).replace(r"\s", r"[\t\n\f\r ]") if ascii_words else f"(?iU){pattern}"


def extract(df: DataFrame, column: str = "text", field: str = "content_text", least: float = 0.5, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS), ascii_words: bool = False) -> DataFrame:
    """``df`` without the text, one row per match: entity_type, pattern, start, value, confidence, context, which replace columns of these names.

    Words end as in Unicode; with ``ascii_words`` a letter beyond ASCII is no part of a word.
    """
    # The lower-case text shows cheaply which patterns can match at all.
    low, e = unused(df, "low", "hit")
    df = df.withColumn(low, folded(column))
    text, parts = F.col(column), []
    for kind in kinds:
        for number, (pattern, bonus) in enumerate(ENTITY_PATTERNS[kind]):
            confidence = BASE_CONFIDENCE + bonus + FIELD_BONUS.get(field, 0.0)
            if confidence >= least:
                rule = _rule(pattern, ascii_words)
                none = F.array().cast("array<struct<entity_type:string,pattern:int,start:int,value:string,confidence:double,context:string>>")
                hinted = reduce(lambda a, b: a | b, [F.col(low).contains(h) for h in HINTS[kind][number]])
                parts.append(F.when(hinted, F.transform(spans(text, rule), _found(text, kind, number, rule, confidence))).otherwise(none))
    keep = _kept(df, column, low, "entity_type", "pattern", "start", "value", "confidence", "context")
    return df.select(*keep, F.explode(F.concat(*parts)).alias(e)).select(*keep, f"{e}.*")


def _field(pages: DataFrame, name: str) -> Column:
    """A field's text; headings, which are texts or structs with a text, are joined."""
    if name != "headings":
        return F.col(name)
    texts = isinstance(pages.schema[name].dataType.elementType, StringType)
    return heading_text(F.col(name) if texts else name, " ")


def from_pages(pages: DataFrame, least: float = 0.5, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS), ascii_words: bool = False) -> DataFrame:
    """The finds in a page's title, meta_description, content_text and headings, with ``field, field_ord``.

    ``headings`` are texts or structs with a text. A find's confidence is held against ``least`` with its
    field's bonus, before it is limited to 1. Other columns pass through; blank fields give no rows.
    """
    keep, (one,) = _kept(pages, *FIELDS, "field", "field_ord", "text"), unused(pages, "one")
    fields = [F.struct(F.lit(n).alias("field"), F.lit(i).alias("field_ord"), _field(pages, n).alias("text")) for i, n in enumerate(FIELDS)]
    rows = pages.select(*keep, F.explode(F.array(*fields)).alias(one)).select(*keep, f"{one}.*").filter(strip("text") != "")
    bonus = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_BONUS.items() for x in kv]), "field"), F.lit(0.0))
    found = extract(rows, field="", least=0.0, kinds=kinds, ascii_words=ascii_words).withColumn("confidence", F.col("confidence") + bonus)
    return found.filter(F.col("confidence") >= least).withColumn("confidence", F.least("confidence", F.lit(1.0)))


def named_products(df: DataFrame, column: str = "text", field: str = "content_text") -> DataFrame:
    """One row per product that a rule over neighbouring words names in the cleaned text; no model is needed.

    Confidence starts at 0.7 and grows with the field and with a capital at the start; all have two words or more.
    """
    keep, (s,) = _kept(df, column, "entity_type", "start", "value", "confidence"), unused(df, "span")
    rows = df.select(*keep, F.explode(spans(clean(F.col(column)), f"(?i){NAMED_PRODUCT}")).alias(s))
    sure = F.lit(0.8 + NAMED_FIELD_BONUS.get(field, 0.0)) + F.when(F.rlike(f"{s}.hit", F.lit(r"^\p{Lu}")), 0.1).otherwise(0.0)
    return rows.select(*keep, F.lit("product").alias("entity_type"), F.col(f"{s}.start").alias("start"), F.col(f"{s}.hit").alias("value"), F.least(sure, F.lit(1.0)).alias("confidence"))


def best_per_page(found: DataFrame, page: str) -> DataFrame:
    """One row per page, normal value and type: the most confident, then the first."""
    order = [c for c in ("field_ord", "pattern", "start") if c in found.columns]
    rows = found.withColumn("normalized_value", normalize_value("value"))
    keys = [page, "normalized_value", "entity_type"]
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("confidence", *[-F.col(c) for c in order])).alias("_best"))
    return best.select([F.col(f"_best.{c}") if c in rest else F.col(c) for c in rows.columns])


def prices(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per price phrase: value, subtype, confidence."""
    return _phrases(df, column, [(f"(?iU){p}", k, c) for p, k, c in PRICE_PHRASES])


def product_names(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per product-name phrase whose core name has over two characters: value, core_name, subtype, confidence."""
    rows = _phrases(df, column, [(f"(?U){p}", k, 0.7) for p, k in NAME_PHRASES], core=True, ends=NAME_ENDS)
    return rows.filter(F.length("core_name") > 2)


#: A character that no name phrase holds.
_APART = r"(?U)[^a-zA-Z\s\d.]|\.(?!\s*\d)"


def _near(pieces: Column, end: str) -> Column:
    """The pieces of a text that hold a phrase's end, with a character between them that no phrase holds."""
    return F.array_join(F.filter(pieces, lambda x: x.rlike(end)), "|")


def _phrases(df: DataFrame, column: str, phrases: list, core: bool = False, ends: list[str] | None = None) -> DataFrame:
    """``ends`` are what each phrase must hold; a phrase is looked for only in the pieces of a text, between characters that no phrase holds, that do."""
    keep, (one, parts) = _kept(df, column, "value", "core_name", "subtype", "confidence"), unused(df, "phrase", "parts")
    # A phrase that starts at every capital of a long text and runs to its end, in vain, would take the square of the text's length.
    texts = [F.col(column)] * len(phrases)
    if ends is not None:
        df = df.withColumn(parts, F.split(column, _APART, -1))
        names = unused(df, *[f"near{i}" for i in range(len(ends))])
        df = df.select(*keep, *[_near(F.col(parts), e).alias(n) for n, e in zip(names, ends, strict=True)])
        texts = [F.col(n) for n in names]
    arrays = []
    for (pattern, kind, confidence), text in zip(phrases, texts, strict=True):
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("v"), F.regexp_extract_all(text, F.lit(pattern), 1).alias("c"))
        arrays.append(F.transform(both, _phrase(kind, confidence)))
    out = df.select(*keep, F.explode(F.concat(*arrays)).alias(one)).select(*keep, f"{one}.*")
    return out if core else out.drop("core_name")


def _phrase(kind: str, confidence: float):
    return lambda x: F.struct(F.trim(x["v"]).alias("value"), F.trim(x["c"]).alias("core_name"), F.lit(kind).alias("subtype"), F.lit(confidence).alias("confidence"))


def store(found: DataFrame, merge: bool = True) -> DataFrame:
    """Entities of ``found(project, entity_type, value, confidence, context, ord)``, one per project, normal value and type.

    The first value by ``ord`` stands; confidence and context are those of the most confident find;
    frequency counts all. Without ``merge`` every find stays a row of its own.
    """
    rows = found.withColumn("normalized_value", normalize_value("value"))
    if not merge:
        return rows.withColumn("frequency", F.lit(1).cast("long")).drop("ord")
    return rows.groupBy("project", "normalized_value", "entity_type").agg(
        F.min_by("value", "ord").alias("value"), F.max("confidence").alias("confidence"), F.min_by("context", F.struct(-F.col("confidence"), F.col("ord"))).alias("context"), F.count("*").alias("frequency"), F.min("ord").alias("ord")
    )


def ranked(entities: DataFrame, kind: str | None = None, least: float = 0.0, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the entities by confidence, ties by id."""
    rows = entities if kind is None else entities.filter(F.col("entity_type") == kind)
    return rows.filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "ord").offset(offset).limit(limit)


def statistics(entities: DataFrame) -> DataFrame:
    """Counts and mean confidence by type; halves of a hundredth round up, whatever the order of the sum."""
    return entities.groupBy("project", "entity_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence").cast("decimal(18,9)"), 2).cast("double").alias("avg_confidence"))


def confidence_bands(entities: DataFrame) -> DataFrame:
    """High, medium and low counts per project; each band includes those above it."""
    return entities.groupBy("project").agg(F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") >= 0.5).alias("medium"), F.count("*").alias("low"))


def overview(entities: DataFrame) -> DataFrame:
    """Totals of each project, with a null type, and of each of its types, in one pass: ``(project, entity_type, whole, total, avg_confidence, high, medium, low)``.

    ``whole`` tells a project's total from a type that is null.
    """
    bands = [F.count_if(F.col("confidence") >= least).alias(n) for n, least in (("high", 0.8), ("medium", 0.5), ("low", 0.0))]
    p, t = F.col("project"), F.col("entity_type")
    sets = entities.groupingSets([[p], [p, t]], p, t).agg(F.grouping("entity_type").alias("whole"), F.count("*").alias("total"), F.round(F.avg("confidence").cast("decimal(18,9)"), 2).cast("double").alias("avg_confidence"), *bands)
    return sets.select("project", "entity_type", (F.col("whole") == 1).alias("whole"), "total", "avg_confidence", "high", "medium", "low")


#: How many entities a page has at most.
MOST = 200


def cluster(entities: DataFrame, path: str, files: int | None = None) -> DataFrame:
    """``entities`` as Parquet in the order of the list, by project, confidence and id, so that a page's filter leaves most files and row groups unread."""
    order = [F.col("project"), F.desc("confidence"), F.col("entity_id")]
    dealt = entities.repartitionByRange(files, *order) if files else entities.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    return entities.sparkSession.read.schema(entities.schema).parquet(path)


def list_page(entities: DataFrame, project: str, kind: str | None = None, least: float = 0.0, limit: int = 50, after: tuple[float, str] | None = None) -> DataFrame:
    """One page of a project's entities by confidence, ties by ``entity_id``: those that follow ``after``, the last page's last confidence and id.

    Limits are held between 1 and MOST. Rows of earlier pages are neither sorted nor, in a clustered table, read.
    """
    rows = entities.filter((F.col("project") == project) & (F.col("confidence") >= least))
    rows = rows if kind is None else rows.filter(F.col("entity_type") == kind)
    if after is not None:
        confidence, id_ = after
        rows = rows.filter(F.col("confidence") <= confidence).filter((F.col("confidence") < confidence) | (F.col("entity_id") > id_))
    return rows.orderBy(F.desc("confidence"), "entity_id").limit(max(1, min(MOST, limit)))


def listed(entities: DataFrame, project: str, kind: str | None = None, least: float = 0.0, limit: int = 50, after: tuple[float, str] | None = None) -> tuple[list, int, tuple[float, str] | None]:
    """A page's rows, how many there are in all, and what the next page comes after; None after the last."""
    rows = list_page(entities, project, kind, least, limit, after).collect()
    own = entities.filter((F.col("project") == project) & (F.col("confidence") >= least))
    total = (own if kind is None else own.filter(F.col("entity_type") == kind)).count()
    return rows, total, ((rows[-1]["confidence"], rows[-1]["entity_id"]) if len(rows) == max(1, min(MOST, limit)) else None)


# Relations from an earlier entity of one type to a later one of another. With a space for a
# line below it, a relation's name is what its description says.
RELATIONS = [("brand", "product", "offers", 0.7), ("product", "feature", "has_feature", 0.6), ("service", "location", "available_in", 0.5)]


def relations(entities: DataFrame, least: float = 0.8) -> DataFrame:
    """``(project, source, target, relation, confidence)`` between a project's earlier and later entities.

    Typed relations join on the pair of types. Similar values (Jaccard above ``least``) of one type are
    found through their rarest words: of two sets that similar, the rarest words of each meet.
    """
    e = entities.select("project", "ord", "entity_type", "normalized_value")
    pair = F.create_map(*[F.lit(x) for a, b, *_ in RELATIONS for x in (a, b)])
    a, b = e.withColumn("wants", F.try_element_at(pair, "entity_type")).alias("a"), e.alias("b")
    typed = a.join(b, F.expr("a.project = b.project and a.wants = b.entity_type and a.ord < b.ord"))
    named = F.create_map(*[F.lit(x) for s, _, r, _ in RELATIONS for x in (s, r)])
    sure = F.create_map(*[F.lit(x) for s, _, _, c in RELATIONS for x in (s, c)])
    out = typed.select("a.project", F.col("a.ord").alias("source"), F.col("b.ord").alias("target"), named[F.col("a.entity_type")].alias("relation"), sure[F.col("a.entity_type")].alias("confidence"))
    w = e.withColumn("words", F.array_distinct(words("normalized_value")))
    seen = w.select("project", "entity_type", F.explode("words").alias("w")).groupBy("project", "entity_type", "w").agg(F.count("*").alias("n"))
    by_rarity = w.select("project", "entity_type", "ord", F.size("words").alias("size"), F.explode("words").alias("w")).join(seen, ["project", "entity_type", "w"]).groupBy("project", "entity_type", "ord", "size").agg(F.sort_array(F.collect_list(F.struct("n", "w"))).alias("ws"))
    prefix = F.slice("ws", 1, F.col("size") - F.ceil(F.col("size") * least).cast("int") + 1)
    keyed = by_rarity.select("project", "entity_type", "ord", F.explode(prefix).alias("x")).select("project", "entity_type", "ord", "x.w")
    met = keyed.alias("a").join(keyed.alias("b"), F.expr("a.project = b.project and a.entity_type = b.entity_type and a.w = b.w and a.ord < b.ord")).select("a.project", F.col("a.ord").alias("source"), F.col("b.ord").alias("target")).distinct()
    va = e.select("project", F.col("ord").alias("source"), F.col("normalized_value").alias("va"))
    vb = e.select("project", F.col("ord").alias("target"), F.col("normalized_value").alias("vb"))
    alike = met.join(va, ["project", "source"]).join(vb, ["project", "target"]).withColumn("confidence", similarity("va", "vb")).filter(F.col("confidence") > least)
    return out.unionByName(alike.select("project", "source", "target", F.lit("similar").alias("relation"), "confidence"))


def relation_ranges(entities: DataFrame) -> DataFrame:
    """The typed relations of ``relations`` without their pairs: ``(project, source, relation, confidence, target_type, first, n)``.

    A source is related to the ``n`` entities of the type that come after it in the project; these are its type's numbers ``first`` and up, counted
    from 0 by ord. There is one row an entity at most. Entities are numbered by ranges: what a range holds of each type is counted, and
    the counts of the ranges before are added, so that no task orders a whole project.
    """
    kinds = sorted({t for _, t, *_ in RELATIONS})
    e = entities.select("project", "ord", "entity_type")
    dealt = stored(e.repartitionByRange("project", "ord").withColumn("range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("project", "range").agg(*[F.count_if(F.col("entity_type") == t).alias(t) for t in kinds])
    up_to = W.partitionBy("project").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("project", "range", *[F.coalesce(F.sum(t).over(up_to), F.lit(0)).alias(f"{t}_before") for t in kinds], *[F.sum(t).over(W.partitionBy("project")).alias(f"{t}_all") for t in kinds])
    inside = W.partitionBy("project", "range").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = dealt.select("*", *[F.count_if(F.col("entity_type") == t).over(inside).alias(f"{t}_in") for t in kinds]).join(counts, ["project", "range"])
    out = F.lit(None)
    for s, t, r, c in RELATIONS:
        first = F.col(f"{t}_before") + F.col(f"{t}_in")
        one = F.struct(F.lit(r).alias("relation"), F.lit(c).alias("confidence"), F.lit(t).alias("target_type"), first.alias("first"), (F.col(f"{t}_all") - first).alias("n"))
        out = F.when(F.col("entity_type") == s, one).otherwise(out)
    return rows.select("project", F.col("ord").alias("source"), out.alias("r")).select("project", "source", "r.*").filter("n > 0")


def expanded(ranges: DataFrame, entities: DataFrame) -> DataFrame:
    """The pairs of some ``relation_ranges`` with their texts: ``(project, source, target, relation, confidence, description)``."""
    e = entities.select("project", "ord", "entity_type", "value")
    kinds = sorted({t for _, t, *_ in RELATIONS})
    targets = e.filter(F.col("entity_type").isin(kinds)).withColumn("number", F.row_number().over(W.partitionBy("project", "entity_type").orderBy("ord")) - 1)
    a, b = ranges.alias("a"), targets.alias("b")
    pairs = a.join(b, F.expr("a.project = b.project and a.target_type = b.entity_type and b.number >= a.first")).select("a.project", "a.source", F.col("b.ord").alias("target"), "a.relation", "a.confidence")
    return described(pairs, entities)


def described(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """``pairs(project, source, target, relation, ...)`` with a ``description`` for readers."""
    v = lambda end, name: entities.select("project", F.col("ord").alias(end), F.col("value").alias(name))
    a, b = unused(pairs, "source_value", "target_value")
    both = pairs.join(v("source", a), ["project", "source"]).join(v("target", b), ["project", "target"])
    said = F.when(F.col("relation") == "similar", F.concat(F.lit("Similar entities: "), F.col(a), F.lit(" and "), F.col(b))).otherwise(F.concat(F.col(a), F.lit(" "), F.translate("relation", "_", " "), F.lit(" "), F.col(b)))
    return both.select(*pairs.columns, said.alias("description"))


def new_relations(found: DataFrame, known: DataFrame) -> DataFrame:
    return found.join(known, ["project", "source", "target", "relation"], "left_anti")


def delete_project(entities: DataFrame, links: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """The entities and relations left when a project's entities go, with the relations at either end."""
    gone = entities.filter(F.col("project") == project).select("project", "ord")
    left = links
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("ord", end), ["project", end], "left_anti")
    return entities.filter(F.col("project") != project), left.select(*links.columns)


def ruled(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per match of the seven rules over neighbouring words in the cleaned text: rule, label, start, value."""
    keep = _kept(df, column, "rule", "label", "start", "value")
    c, r, low = unused(df, "_clean", "_rule", "_low")
    rows = df.select(*keep, clean(F.col(column)).alias(c))
    one = lambda i, label: lambda x: F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), x["start"].alias("start"), x["hit"].alias("value"))
    rows = rows.withColumn(low, folded(c))
    none = F.array().cast("array<struct<rule:int,label:string,start:int,value:string>>")
    found = []
    for i, ((label, p), hints) in enumerate(zip(RULER, RULER_HINTS, strict=True)):
        hinted = reduce(lambda a, b: a | b, [F.col(low).contains(h) for h in hints])
        rule = f"(?U){p}"  # words end as in Unicode
        found.append(F.when(hinted & F.col(c).rlike(rule), F.transform(spans(F.col(c), rule), one(i, label))).otherwise(none))
    return rows.select(*keep, F.explode(F.concat(*found)).alias(r)).select(*keep, f"{r}.*")


def extracted(pages: DataFrame, least: float = 0.5, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS), model=None, ascii_words: bool = False) -> DataFrame:
    """A page's entities by names, first, and by patterns, the best of each value and type.

    ``pages(project, page_id, title, meta_description, content_text, headings)``. Names are what a ``model`` of
    ``operators.tagger`` finds or, without one, the rules for products. The finds carry ``ord``, their order in the project.
    """
    by_pattern = from_pages(pages, least, kinds, ascii_words).withColumns({"engine": F.lit(1), "kind": F.array_position(F.array(*map(F.lit, ENTITY_PATTERNS)), F.col("entity_type"))})
    keep = [c for c in pages.columns if c not in FIELDS]
    columns = [*keep, "field", "field_ord", "engine", "kind", "pattern", "entity_type", "start", "value", "confidence", "context"]
    found = by_pattern.select(*columns)
    for i, name in enumerate(FIELDS):
        texts = pages.select(*keep, _field(pages, name).alias("text")).filter(F.col("text").isNotNull())
        if model is not None:
            named = tagger.named(texts, model, field=name, least=least).filter(F.col("entity_type").isin(*kinds))
        elif "product" in kinds:
            named = named_products(texts, field=name).filter(F.col("confidence") >= least).withColumn("context", F.col("value"))
        else:
            continue
        extra = {"field": F.lit(name), "field_ord": F.lit(i), "engine": F.lit(0), "kind": F.lit(0).cast("long"), "pattern": F.lit(0)}
        found = found.unionByName(named.withColumns(extra).select(*columns))
    order = F.struct("page_id", "field_ord", "engine", "kind", "pattern", "start")
    return best_per_page(found.withColumn("ord", order), "page_id")


def extract_and_store(pages: DataFrame, least: float = 0.5, kinds: tuple[str, ...] = tuple(ENTITY_PATTERNS), ascii_words: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A summary a project, the entities and their relations, from the crawled ones of ``pages(project, page_id, status, ...)``.

    The summary has ``status`` (``completed``, or ``no_pages`` where no page is crawled), ``pages_processed``
    and ``entities_extracted``, the finds before they are merged across pages.
    """
    done = pages.filter(F.col("status") == "crawled").drop("status")
    found = settled(extracted(done, least, kinds, ascii_words=ascii_words))
    kept = store(found.select("project", "entity_type", "value", "confidence", "context", "ord"))
    counted = pages.groupBy("project").agg(F.count_if(F.col("status") == "crawled").alias("pages_processed")).join(found.groupBy("project").agg(F.count("*").alias("entities_extracted")), "project", "left")
    summary = counted.select("project", F.when(F.col("pages_processed") > 0, "completed").otherwise("no_pages").alias("status"), "pages_processed", F.coalesce("entities_extracted", F.lit(0)).cast("long").alias("entities_extracted"))
    return summary, kept, relations(kept)
