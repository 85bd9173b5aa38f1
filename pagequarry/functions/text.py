"""Text columns: metrics, cleaning, splitting, importance, and entity value rules."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagequarry.functions.rules import CATEGORIES, CATEGORY_LABELS, FIELD_SCORES, NAVIGATION, NOISE_HINTS, NOISE_TEXT, NOISE_WORDS, STOP_WORDS, URL_RULES


#: A character of white space, and one of another kind: Unicode's, and four control characters that count as such in Python. Spelled out, as
#: looking up a character's property takes longer.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, OTHER = f"[{_SPACES}]", f"[^{_SPACES}]"


def strip(text: Column | str) -> Column:
    """``text`` without white space of any kind at its ends."""
    # Looking for the end at every character takes long; most texts have none at either end.
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(F.rlike(ends, F.lit(SPACE)), F.regexp_replace(text, rf"^{SPACE}++|{SPACE}++$", "")).otherwise(F.col(text) if isinstance(text, str) else text)


def words(text: Column | str) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def metrics(text: Column | str, headings: Column | int = 0) -> dict[str, Column]:
    """Counts of a text's words, characters, sentences, paragraphs and headings, words a sentence, and minutes to read; null for no text."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.size(words(text))
    sentences = F.size(F.filter(F.split(text, r"[.!?]+"), lambda s: s.rlike(OTHER)))
    all_ = {
        "word_count": n,
        "character_count": F.length(text),
        "sentence_count": sentences,
        "paragraph_count": F.size(F.split(text, "\n\n")),
        "heading_count": headings if isinstance(headings, Column) else F.lit(headings),
        "avg_words_per_sentence": F.when(sentences > 0, n / sentences).otherwise(0.0),
        "reading_time_minutes": n / 200.0,
    }
    return {k: F.when(text != "", v) for k, v in all_.items()}


#: What counts as a tag: a comment, or a name after the bracket.
TAG = r"<!--[\s\S]*?-->|<[/!?]?[A-Za-z][^>]*>"
#: What no one reads, to its end tag or the text's end.
UNREAD = r"(?i:<(script|style|template)\b[^>]*>[\s\S]*?(?:</\1\s*>|\Z))"


@F.pandas_udf(StringType())
def plain_text(texts: pd.Series) -> pd.Series:
    """HTML character references resolved, by the standard's table of about 2,200 names, without tags, scripts and styles."""
    tag = re.compile(f"{UNREAD}|{TAG}")
    return texts.map(lambda t: html.unescape(tag.sub("", html.unescape(t))) if t else t)


def clean(text: Column | str) -> Column:
    """White space collapsed, boilerplate phrases and texts that are only navigation removed.

    Character references are resolved before tags go, so an escaped tag goes too, and once more after
    it; text cut out by tags joins without a separator. Null gives an empty text.
    """
    text = F.col(text) if isinstance(text, str) else text
    # Only texts with a mark of HTML go to Python.
    marked = F.when(text.contains("&") | text.contains("<"), text)
    out = F.coalesce(plain_text(marked), text, F.lit(""))
    return _let(F.regexp_replace(out, rf"{SPACE}+", " "), _without_noise)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(text: Column | str) -> Column:
    """``text`` in lower case, with the letters that count as an s or i when case is ignored written so; for hints only, as it may be longer."""
    low = F.lower(text)
    for a, b in (("\u017f", "s"), ("\u0131", "i"), ("i\u0307", "i")):
        low = F.replace(low, F.lit(a), F.lit(b))
    return low


def _without_noise(text: Column) -> Column:
    out = text
    for p in NOISE_TEXT:
        out = F.regexp_replace(out, f"(?i){p}", "")
    # Where none of the phrases is, none can come about by removing others.
    hinted = _let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [low.contains(h) for h in NOISE_HINTS]))
    return strip(F.regexp_replace(F.when(hinted, out).otherwise(text), f"(?i)^(?:{NAVIGATION})$", ""))


def split_at(text: Column | str, most: int = 2000) -> Column:
    """``struct<main,secondary>``: a long text cut at a paragraph, else a sentence, else at ``most``."""
    text = F.col(text) if isinstance(text, str) else text
    head = F.substring(text, 1, most)
    last = lambda mark: most - F.instr(F.reverse(head), mark[::-1]) - len(mark) + 1
    paragraph, sentence = F.when(F.instr(head, "\n\n") > 0, last("\n\n")).otherwise(-1), F.when(F.instr(head, ". ") > 0, last(". ")).otherwise(-1)
    at = F.when(paragraph > most * 0.7, paragraph).when(sentence > most * 0.8, sentence + 1).otherwise(F.lit(most))
    whole = F.length(text) <= most
    return F.struct(
        F.when(whole, text).otherwise(F.substring(text, F.lit(1), at)).alias("main"),
        F.when(whole, "").otherwise(F.substring(text, at + 1, F.length(text))).alias("secondary"),
    )


def importance(text: Column | str, field: str) -> Column:
    """How much a field's text counts, at most 1."""
    s = F.lit(FIELD_SCORES.get(field, 0.3))
    if field in ("title", "headings"):
        s = s + F.when(F.length(text) < 100, 0.1).otherwise(0.0)
    s = s + F.when(F.rlike(text, F.lit(r"(?U)\b[A-Z][a-z]+\b")), 0.05).otherwise(0.0)
    s = s + F.when(F.rlike(text, F.lit(r"(?U)\$\d+|\d+%|\d+\.\d+")), 0.1).otherwise(0.0)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(FIELD_SCORES.get(field, 0.3))).otherwise(F.least(s, F.lit(1.0)))


def normalize_value(value: Column | str) -> Column:
    """An entity value for comparison: lower case, one article before and one company form after it removed."""
    v = F.regexp_replace(F.lower(strip(value)), rf"{SPACE}+", " ")
    return F.regexp_replace(F.regexp_replace(v, r"^(the|a|an)\s+", ""), r"\s+(inc|llc|corp|ltd|co)\.?$", "")


def similarity(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of two values' sets of words; 0 if neither has any."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def is_noise(value: Column | str) -> Column:
    """Stop words, navigation words, and values of under two letters, digits or underscores."""
    low = F.lower(strip(value))
    return (F.length(low) < 2) | low.isin(*STOP_WORDS) | F.rlike(value, F.lit(f"(?i)^(?:{NAVIGATION})$")) | (F.length(F.regexp_replace(low, r"(?U)[^\w\s]", "")) < 2)


def good_entity(value: Column | str, kind: Column | str) -> Column:
    """Long enough, not mostly signs, not mostly digits unless a price, and without a noise word in it."""
    n = F.length(value)
    share = lambda p: F.try_divide(F.regexp_count(value, F.lit(p)), n)
    noisy = reduce(lambda x, y: x | y, [F.contains(F.lower(value), F.lit(w)) for w in NOISE_WORDS])
    return F.coalesce((F.length(strip(value)) >= 2) & (share(r"(?U)[^\w\s]") <= 0.5) & ((kind == "price") | (share(r"(?U)\d") <= 0.7)) & ~noisy, F.lit(False))


def categories(spark) -> DataFrame:
    """The page types that a classification can give, as rows."""
    return spark.createDataFrame([(t,) for t in URL_RULES], "page_type string")


def heading_text(headings: Column | str, between: str = " | ") -> Column:
    """The texts of headings, an array of texts or of structs with a text, in one."""
    return F.array_join(F.col(f"{headings}.text") if isinstance(headings, str) else headings, between)


def structured_text(data: Column | str, between: str = " | ") -> Column:
    """The non-blank strings of a JSON text, in order, without names and numbers."""
    # A name is matched with its colon and left out, so that no string starts at a name's end.
    found = F.filter(F.regexp_extract_all(data, F.lit(r'("(?:[^"\\]|\\.)*+"(?:\s*+:)?)'), 1), lambda x: F.endswith(x, F.lit('"')))
    strings = F.from_json(F.concat(F.lit("["), F.array_join(found, ","), F.lit("]")), "array<string>")
    return F.array_join(F.filter(strings, lambda x: F.trim(x) != ""), between)


def segments(title, meta_description, headings, content, structured=None) -> Column:
    """A page's cleaned texts by their part; parts without a text are null."""
    halves = split_at(clean(content))
    part = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        part(clean(title)).alias("title"),
        part(clean(meta_description)).alias("meta_description"),
        part(clean(headings)).alias("headings"),
        part(halves["main"]).alias("content_main"),
        part(halves["secondary"]).alias("content_secondary"),
        (part(structured_text(structured)) if structured is not None else F.lit(None).cast("string")).alias("structured_data"),
    )


def category_ok(category: Column | str) -> Column:
    """Whether a business category is a known one, or left out."""
    c = F.col(category) if isinstance(category, str) else category
    return F.coalesce(c == "", F.lit(True)) | F.coalesce(c.isin(*CATEGORIES), F.lit(True))


def category_label(category: Column | str) -> Column:
    """A business category's label; the category itself if it has none."""
    names = F.create_map(*[F.lit(x) for kv in zip(CATEGORIES, CATEGORY_LABELS, strict=True) for x in kv])
    return F.coalesce(F.try_element_at(names, category if isinstance(category, Column) else F.col(category)), category if isinstance(category, Column) else F.col(category))
