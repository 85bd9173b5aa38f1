"""The tagger against the rules that taught it, on texts it has not seen, with names it has not seen."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import entities, tagger

NAMES = ["Acme", "Globex", "Initech", "Umbrella", "Stark", "Wayne", "Hooli", "Vandelay", "Tyrell", "Cyberdyne", "Soylent", "Massive", "Aperture", "Wonka"]
CITIES = ["Berlin", "Austin", "Paris", "Denver", "Boston", "Lyon", "Madrid", "Dallas"]


def sentence(rng, names, cities):
    n, c = rng.choice(names), rng.choice(cities)
    return rng.choice(
        [
            f"We met the people of {n} Inc. last week.", f"{n} Corp is growing again.", f"Try the {n} Platform today.", f"The {n} Software costs ${rng.randrange(5, 99)} per month.", f"It is based in {c} and nowhere else.",
            f"Headquarters in {c}, TX.", f"They sell Consulting Services and Web Development.", f"You get {rng.randrange(5, 60)}% off on Monday.", "Nothing of note happened in the afternoon.", f"{c} was cold and {n.lower()} is a word.", "Our team likes long walks and good coffee.",
        ]
    )


def f1(model, texts):
    right = found = wanted = 0
    for t in texts:
        # Spans by their tokens: a pattern may end in a full stop or blank.
        cover = lambda a, b: tuple(x for x in tagger.tokens(t) if a <= x[0] and x[1] <= b)  # noqa: E731, B023
        want = {(cover(a, b), label) for a, b, label in tagger.taught(t)}
        got = {(cover(a, a + len(v)), label) for label, a, v, _ in model.spans(t)}
        right, found, wanted = right + len(want & got), found + len(got), wanted + len(want)
    return 2 * right / (found + wanted)


def test_held_out_names(spark):
    rng = random.Random(1)
    train = [" ".join(sentence(rng, NAMES[:9], CITIES[:5]) for _ in range(3)) for _ in range(500)]
    model = tagger.fit(spark.createDataFrame([(t,) for t in train], "text string"), epochs=4)
    assert f1(model, [sentence(rng, NAMES[:9], CITIES[:5]) for _ in range(400)]) > 0.95
    assert f1(model, [sentence(rng, NAMES[9:], CITIES[5:]) for _ in range(400)]) > 0.9
    texts = [("Globex Inc. opened. Headquarters in Lyon, TX.\nThe Hooli Platform costs $7 per month.", 1), (None, 2), ("", 3), ("x " * 3000, 4)]
    df = spark.createDataFrame([(i, t, "mine") for t, i in texts], "id int, text string, label string")
    got = tagger.named(df, model, field="title").collect()
    assert {r.entity_type for r in got} >= {"brand", "location", "product", "price"} and {r.id for r in got} == {1} and {r.confidence for r in got} == {1.0}
    whole = "Globex Inc. opened. Headquarters in Lyon, TX. The Hooli Platform costs $7 per month."
    assert all(whole[r.start :].startswith(r.value) and r.value in r.context.replace(" .", ".").replace("$ ", "$").replace(" ,", ",") for r in got)


def test_without_words_and_all_types_together(spark):
    model = tagger.fit(spark.createDataFrame([], "text string"))
    assert model.weights == {} and model.spans("Acme Inc. is here") == [] and set(tagger.LABELS.values()) == {"brand", "product", "price", "location", "service"}
    rng = random.Random(2)
    train = [sentence(rng, NAMES, CITIES) for _ in range(800)]
    model = tagger.fit(spark.createDataFrame([(t,) for t in train], "text string"), epochs=3)
    page = spark.createDataFrame([("p", 1, "The Acme Platform", None, "Acme Inc. sells Web Development for $9 per month. Dashboard included. Headquarters in Paris, TX.", ["20% off"])], "project string, page_id long, title string, meta_description string, content_text string, headings array<string>")
    got = entities.extracted(page, model=model)
    assert {r.entity_type for r in got.collect()} == {"brand", "product", "price", "location", "service", "feature"} and got.groupBy("normalized_value", "entity_type").count().filter("count > 1").isEmpty()
    assert got.filter(F.col("engine") == 0).count() > 0


def test_many_sentences_at_once_are_tagged_as_one_by_one():
    """The table gives the tags that decoding each sentence gives, in odd texts too."""
    from pagequarry.plans.catalogue import OFFERS

    model = tagger.learn([s for o in OFFERS for s in o.split(". ")] * 3 + ["a | b", "| | x"])
    texts = [*OFFERS, "", None, "|", "a | b || c |", "Acme Inc\n\nPro | v2. Z", "one " * 1000, "ſK İ é", "a.b.c. d! e? Omega Suite"]
    table = tagger.Table(model)
    for t in filter(None, texts):
        at = tagger.tokens(t)
        ws, begins = [t[a:b] for a, b in at], tagger.segments(t, at)
        want = [x for a, b in zip(begins, [*begins[1:], len(ws)], strict=True) for x in model.decode(tagger.features(ws[a:b]))]
        assert table.decode(ws, begins).tolist() == want
    assert list(table.spans(texts)) == [model.spans(t) if t else [] for t in texts]
    assert any(table.spans(texts))
