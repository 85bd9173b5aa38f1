"""The library's functions for SQL texts: value functions as SQL expressions, and extraction as a table function."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from pagequarry.functions.rules import BASE_CONFIDENCE, ENTITY_PATTERNS, FIELD_BONUS, HINTS

_S = r"[\\s\\x1c-\\x1f]"
#: Name, arguments, result and body. Bodies are expressions, which the optimizer sees through.
SCALARS = {
    "strip_text": ("t STRING", "STRING", rf"regexp_replace(t, '(?U)^{_S}++|(?U){_S}++$', '')"),
    "normalize_value": ("v STRING", "STRING", rf"regexp_replace(regexp_replace(regexp_replace(lower(strip_text(v)), '(?U){_S}+', ' '), '^(the|a|an)\\s+', ''), '\\s+(inc|llc|corp|ltd|co)\\.?$', '')"),
    "value_similarity": (
        "a STRING, b STRING",
        "DOUBLE",
        "coalesce(try_divide(size(array_intersect(array_distinct(filter(split(lower(a), ' '), w -> w <> '')), array_distinct(filter(split(lower(b), ' '), w -> w <> '')))), "
        "size(array_union(filter(split(lower(a), ' '), w -> w <> ''), filter(split(lower(b), ' '), w -> w <> '')))), 0D)",
    ),
    "reading_minutes": ("t STRING", "DOUBLE", rf"CASE WHEN t <> '' THEN size(filter(split(t, '(?U){_S}+'), w -> w <> '')) / 200D END"),
}


def finds(text: str, field: str, least: float, ascii_words: bool = False) -> list[tuple]:
    """``(entity_type, pattern, start, value, confidence, context)`` of a text's matches, as ``operators.entities.extract`` finds them."""
    low, out = text.lower().replace("ſ", "s"), []
    for kind, patterns in ENTITY_PATTERNS.items():
        for number, (pattern, bonus) in enumerate(patterns):
            confidence = BASE_CONFIDENCE + bonus + FIELD_BONUS.get(field, 0.0)
            if confidence >= least and any(h in low for h in HINTS[kind][number]):
                for m in re.finditer(pattern, text, re.IGNORECASE | (re.ASCII if ascii_words else 0)):
                    around = text[max(0, m.start() - 50) : m.end() + 50]
                    out.append((kind, number, m.start(), m[0].strip(" "), min(confidence, 1.0), around.strip(" ")))
    return out


@udtf(returnType="entity_type string, pattern int, start int, value string, confidence double, context string", useArrow=True)
class ExtractEntities:
    """``extract_entities(text, field, least, ascii_words)``: the matches of the entity patterns in a text, for use after LATERAL; none for null. The last may be left out."""

    def eval(self, text: str, field: str, least: float, ascii_words: bool = False):
        yield from finds(text or "", field or "content_text", 0.5 if least is None else float(least), bool(ascii_words))


def register(spark: SparkSession) -> None:
    """Make ``extract_entities`` and the functions of SCALARS known to a session."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("extract_entities", ExtractEntities)
