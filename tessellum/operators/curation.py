"""Lessons, news and curated exports; query texts; highlighting; feature selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import content_tokens, tokens

LESSON = """globalID string, lessonName string,
topics map<string, struct<topicName: string, content: struct<text: string>>>,
adjunctTopics map<string, struct<content: struct<text: string>>>,
questions struct<nonDiagramQuestions: map<string, struct<beingAsked: struct<processedText: string>, correctAnswer: struct<processedText: string>>>>"""
NEWS = "id string, article_url string, author string, published_date bigint, title string, contents array<struct<type: string, subtype: string, content: string>>"


def structured_query(text: Column, operator: str = "sdm", field: str | None = None) -> Column:
    """``#sdm(w1 w2)`` of a text's content words, each with ``.field`` if one is given; empty without words."""
    words = content_tokens(text)
    if field:
        words = F.transform(words, lambda w: F.concat(w, F.lit(f".{field}")))
    return F.when(F.size(words) > 0, F.concat(F.lit(f"#{operator}("), F.array_join(words, " "), F.lit(")"))).otherwise("")


def combined_query(parts: list[Column]) -> Column:
    return F.concat(F.lit("#combine("), F.concat_ws(" ", *[F.when(p != "", p) for p in parts]), F.lit(")"))


def lesson_sections(lessons: DataFrame, intro_only: bool = False) -> DataFrame:
    """(lesson_id, title, kind, heading, text): topics, adjunct topics and questions with their answers."""
    head = [F.col("globalID").alias("lesson_id"), F.col("lessonName").alias("title")]
    topics = lessons.select(*head, F.explode("topics").alias("k", "t")).select("lesson_id", "title", F.lit("topic").alias("kind"), F.col("t.topicName").alias("heading"), F.col("t.content.text").alias("text"))
    extra = lessons.select(*head, F.explode("adjunctTopics").alias("k", "t")).select("lesson_id", "title", F.lower("k").alias("kind"), F.col("k").alias("heading"), F.col("t.content.text").alias("text"))
    if intro_only:
        return extra.where("kind = 'introduction'")
    asked = lessons.select(*head, F.explode("questions.nonDiagramQuestions").alias("k", "q"))
    questions = asked.select("lesson_id", "title", F.lit("question").alias("kind"), F.col("q.beingAsked.processedText").alias("heading"), F.col("q.correctAnswer.processedText").alias("text"))
    return topics.unionByName(extra).unionByName(questions).where("text IS NOT NULL AND trim(text) <> ''")


def curated(sections: DataFrame, titles: DataFrame, headings: DataFrame, include: DataFrame, notes: DataFrame, content: str = "both") -> DataFrame:
    """Sections under review: kept ones with overriding titles and headings, with text, notes or both.

    titles: lesson_id, new_title; headings: lesson_id, heading, new_heading; include: lesson_id, heading; notes: lesson_id, heading, note.
    """
    kept = sections.join(include.distinct(), ["lesson_id", "heading"], "left_semi")
    named = kept.join(titles, "lesson_id", "left").join(headings, ["lesson_id", "heading"], "left").join(notes, ["lesson_id", "heading"], "left")
    body = {"text": F.col("text"), "notes": F.col("note"), "both": F.concat_ws("\n", "text", "note")}[content]
    return named.select("lesson_id", F.coalesce("new_title", "title").alias("title"), F.coalesce("new_heading", "heading").alias("heading"), body.alias("text"))


def compatibility(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, keywords): ids matched by name; keywords are split at ", "."""
    return old.join(new, "name").select("old_id", "new_id", F.filter(F.split("keywords", ", "), lambda k: k != "").alias("keywords"))


def lower_case_titles(sections: DataFrame, include: DataFrame) -> DataFrame:
    return sections.join(include, "lesson_id", "left_semi").withColumns({"title": F.lower("title"), "heading": F.lower("heading")})


def train_test(rows: DataFrame, key: str, train: DataFrame, include: DataFrame | None = None, want_train: bool = True) -> DataFrame:
    kept = rows if include is None else rows.join(include, key, "left_semi")
    return kept.join(train, key, "left_semi" if want_train else "left_anti")


def news_paragraphs(news: DataFrame) -> DataFrame:
    """(id, pos, kind, text): title, subheadings and paragraphs of articles, markup tags removed."""
    parts = news.select("id", F.posexplode("contents").alias("pos", "c")).where("c.content IS NOT NULL")
    kind = F.when(F.col("c.type") == "title", "title").when(F.col("c.subtype") == "subhead", "heading").when(F.col("c.subtype") == "paragraph", "para")
    return parts.select("id", "pos", kind.alias("kind"), F.regexp_replace("c.content", "<[^>]*>", "").alias("text")).where("kind IS NOT NULL")


def articles_of_topics(topics: DataFrame, news: DataFrame) -> DataFrame:
    """Topics with their article by address; those without one stay, with null id."""
    return topics.join(news.select(F.col("article_url").alias("url"), F.col("id").alias("article_id")), "url", "left")


def highlights(texts: DataFrame, keywords: DataFrame) -> DataFrame:
    """(id, stem, n, source): words of a text whose stem is one of its keywords. keywords: id, stem, source."""
    asked = texts.join(keywords.select("id").distinct(), "id", "left_semi")
    words = asked.select("id", F.explode(tokens(F.col("text"))).alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    stems = words.select("w").distinct().select("w", stem(F.col("w")).alias("stem"))  # every different word once
    return words.join(stems, "w").groupBy("id", "stem").agg(F.sum("n").alias("n")).join(keywords.distinct(), ["id", "stem"])


def feature_subset(names: list[str], **flags: str) -> list[str]:
    """Feature columns whose name holds every flag's part; an empty selection keeps none."""
    return [n for n in names if all(part in n for part in flags.values())]


def missing_edges(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Unordered expected pairs (a, b) that were not found."""
    undirected = lambda d: d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return undirected(expected).subtract(undirected(found))


def text_vectors(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """(id, dim, value): mean of the vectors of a text's known words. words: id, word; vectors: word, vector."""
    v = vectors.select("word", F.posexplode("vector").alias("dim", "x"))
    return words.join(v, "word").groupBy("id", "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))
