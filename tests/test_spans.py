"""Texts are searched once for each pattern that may match."""

import re

from pyspark.sql import functions as F

from pagequarry.operators import entities


def test_spans_and_single_search(spark):
    texts = ["", "pro one", "a pro one, pro two\U0001f600 pro x", "\U0001f600pro pro", None, "none here"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", entities.spans(F.col("t"), r"pro \w+").alias("s")).orderBy("i").collect()
    for r in got:
        want = None if texts[r.i] is None else [(m.start(), m.group()) for m in re.finditer(r"pro \w+", texts[r.i])]
        assert (None if r.s is None else [tuple(x) for x in r.s]) == want
    df = spark.createDataFrame([("Save: $5 and Pro: $7.50 a month, free: $ none",)], "text string")
    found = entities.extract(df, kinds=("price",))
    assert {(r.pattern, r.value) for r in found.collect()} >= {(2, "Pro: $7.50"), (4, "Save: $5")}
    assert "RLIKE" not in found._jdf.queryExecution().optimizedPlan().toString().upper()


def test_spans_of_a_text_that_python_cleans(spark):
    """The cleaned text comes from a Python function; the finds lie where the cleaned text has them."""
    texts = ["<b>The Delta</b> Suite &amp; more", "The Delta Suite", "", None]
    got = entities.named_products(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    assert [(r.i, r.start, r.value) for r in got.orderBy("i").collect()] == [(0, 4, "Delta Suite"), (1, 4, "Delta Suite")]
