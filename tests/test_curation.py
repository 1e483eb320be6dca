import json

from helpers import rows
from pyspark.sql import functions as F

from tessellum.operators import curation


def lessons(spark):
    one = {
        "globalID": "L1", "lessonName": "Rivers",
        "topics": {"T1": {"topicName": "Flow", "content": {"text": "Water flows."}}, "T2": {"topicName": "Empty", "content": {"text": " "}}},
        "adjunctTopics": {"Introduction": {"content": {"text": "Hello."}}, "Vocabulary": {"delta": "word"}},
        "questions": {"nonDiagramQuestions": {"q1": {"beingAsked": {"processedText": "Why?"}, "correctAnswer": {"processedText": "Because"}}}},
    }
    raw = spark.createDataFrame([(json.dumps(one),)], "j string")
    return raw.select(F.from_json("j", curation.LESSON).alias("l")).select("l.*")


def test_lessons(spark):
    got = rows(curation.lesson_sections(lessons(spark)).select("kind", "heading", "text"))
    assert got == [("introduction", "Introduction", "Hello."), ("question", "Why?", "Because"), ("topic", "Flow", "Water flows.")]
    assert rows(curation.lesson_sections(lessons(spark), intro_only=True).select("heading")) == [("Introduction",)]


def test_curation(spark):
    s = curation.lesson_sections(lessons(spark))
    titles = spark.createDataFrame([("L1", "Streams")], "lesson_id string, new_title string")
    heads = spark.createDataFrame([("L1", "Flow", "Flowing")], "lesson_id string, heading string, new_heading string")
    include = spark.createDataFrame([("L1", "Flow"), ("L1", "Why?")], "lesson_id string, heading string")
    notes = spark.createDataFrame([("L1", "Flow", "note")], "lesson_id string, heading string, note string")
    assert rows(curation.curated(s, titles, heads, include, notes)) == [("L1", "Streams", "Flowing", "Water flows.\nnote"), ("L1", "Streams", "Why?", "Because")]
    assert rows(curation.curated(s, titles, heads, include, notes, "notes").select("text").where("text IS NOT NULL")) == [("note",)]
    assert curation.lower_case_titles(s, titles.select("lesson_id")).first()["title"] == "rivers"
    assert curation.train_test(s, "lesson_id", titles.select("lesson_id"), want_train=False).count() == 0
    old = spark.createDataFrame([("o", "n", "a, b, ")], "old_id string, name string, keywords string")
    assert curation.compatibility(old, spark.createDataFrame([("x", "n")], "new_id string, name string")).first()["keywords"] == ["a", "b"]


def test_news(spark):
    news = spark.createDataFrame([("n1", "http://a", None, 1, "T", [("title", None, "T"), ("sanitized_html", "paragraph", "<b>P</b>."), ("kicker", None, "K"), ("sanitized_html", "subhead", None)])], curation.NEWS)
    assert rows(curation.news_paragraphs(news)) == [("n1", 0, "title", "T"), ("n1", 1, "para", "P.")]
    topics = spark.createDataFrame([("1", "http://a"), ("2", "http://b")], "topic string, url string")
    assert rows(curation.articles_of_topics(topics, news).select("topic", "article_id")) == [("1", "n1"), ("2", None)]


def test_queries_features_and_edges(spark):
    df = spark.createDataFrame([("The deep Rivers",), ("",)], "t string")
    q = curation.combined_query([curation.structured_query(F.col("t")), curation.structured_query(F.col("t"), "rm", "title")])
    assert [r[0] for r in df.select(q).collect()] == ["#combine(#sdm(deep rivers) #rm(deep.title rivers.title))", "#combine()"]
    assert curation.feature_subset(["edge-bm25-top", "node-bm25", "edge-ql"], kind="edge", model="bm25") == ["edge-bm25-top"]
    a = spark.createDataFrame([(2, 1), (3, 4)], "a int, b int")
    assert rows(curation.missing_edges(a, spark.createDataFrame([(1, 2)], "a int, b int"))) == [(3, 4)]
    words = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "id int, word string")
    vectors = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 3.0])], "word string, vector array<float>")
    assert rows(curation.text_vectors(words, vectors)) == [(1, 0, 0.5), (1, 1, 1.5)]
