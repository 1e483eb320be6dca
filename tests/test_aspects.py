import json

from helpers import rows

from tessellum.operators import aspects


def example(i, true, candidates, mentions=()):
    text = {"content": "Ann met Bob & Co.", "entities": [{"entity_name": e, "entity_id": e, "mention": e, "start": a, "end": b} for e, a, b in mentions]}
    place = {"location_id": "l", "page_id": "p", "page_title": "P", "section_id": "s", "section_headings": ["h"]}
    return json.dumps({"unhashed_id": "u", "id": i, "context": {"target_entity": "ann", "location": place, "sentence": text, "paragraph": text}, "true_aspect": true, "candidate_aspects": [{"aspect_id": c, "location": place, "aspect_content": text, "aspect_name": c.upper()} for c in candidates]})


def test_checks_and_texts(spark):
    lines = [example("e1", "a", ["a", "b"], [("bob", 8, 11), ("ann", 0, 3), ("over", 1, 5), ("far", 12, 99)]), example("e2", "x", ["a"]), example("e3", "a", ["a", "a", "c"]), "{broken", ""]
    ex = aspects.examples(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert rows(aspects.few_candidates(ex, 2)) == sorted([("e2", 1, None), (None, None, "{broken")], key=repr)
    assert rows(aspects.true_aspects(ex)) == [("e1", "one"), ("e2", "none"), ("e3", "several")]
    assert rows(aspects.entity_histogram(ex, 3)) == [("ann", 3)] and aspects.entity_histogram(ex, 4).count() == 0
    from pyspark.sql import functions as F

    parts = ex.where("id = 'e1'").select(aspects.split_text(F.col("context.paragraph.content"), F.col("context.paragraph.entities")).alias("p")).first()["p"]
    assert [tuple(p) for p in parts] == [("Ann", "ann"), (" met ", None), ("Bob", "bob"), (" & Co.", None)]
    assert dict(rows(aspects.verification_lines(ex)))["e1"] == "e1\tann\tAnn met Bob & Co.\n*\ta\tA\n\tb\tB"
    assert dict(rows(aspects.latex(ex)))["e1"] == "\\textbf{Ann} met \\textbf{Bob} \\& Co."
    assert aspects.true_aspects(ex.limit(0)).count() == 0
