"""Examples of links to aspects of entities: reading, checks and text forms.

Rows have the schema of ``EXAMPLE`` and ``error`` (null for rows that could be read).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = "struct<location_id: string, page_id: string, page_title: string, paragraph_id: string, section_id: string, section_headings: array<string>>"
MENTION = "struct<entity_name: string, entity_id: string, mention: string, target_mention: boolean, start: int, end: int>"
TEXT = f"struct<content: string, entities: array<{MENTION}>>"
EXAMPLE = (
    f"unhashed_id string, id string, context struct<target_entity: string, location: {PLACE}, sentence: {TEXT}, paragraph: {TEXT}>, true_aspect string, "
    f"candidate_aspects array<struct<aspect_id: string, location: {PLACE}, aspect_content: {TEXT}, aspect_name: string>>"
)


def examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines to examples; a line that is not one keeps its text in ``error``."""
    parsed = F.from_json(F.col(column), EXAMPLE)
    good = parsed["id"].isNotNull() & parsed["true_aspect"].isNotNull() & parsed["candidate_aspects"].isNotNull()
    return lines.where(F.trim(column) != "").select(F.when(good, parsed).alias("e"), F.when(~F.coalesce(good, F.lit(False)), F.col(column)).alias("error")).select("e.*", "error")


def few_candidates(rows: DataFrame, least: int) -> DataFrame:
    """(id, n_candidates, error): examples with fewer than ``least`` candidates, and unread lines."""
    n = F.size("candidate_aspects")
    return rows.where(F.col("error").isNotNull() | (n < least)).select("id", F.when(F.col("error").isNull(), n).alias("n_candidates"), "error")


def _true(rows_aspects: Column, true: Column) -> Column:
    return F.filter(rows_aspects, lambda a: a["aspect_id"] == true)


def true_aspects(rows: DataFrame) -> DataFrame:
    """(id, found): ``one`` if exactly one candidate is the true aspect, else ``none`` or ``several``."""
    n = F.size(_true(F.col("candidate_aspects"), F.col("true_aspect")))
    return rows.where("error IS NULL").select("id", F.when(n == 0, "none").when(n == 1, "one").otherwise("several").alias("found"))


def entity_histogram(rows: DataFrame, least: int = 1) -> DataFrame:
    """(target_entity, n) of at least ``least`` examples."""
    return rows.where("error IS NULL").groupBy("context.target_entity").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def split_text(text: Column, mentions: Column) -> Column:
    """Array of (text, entity): the text cut at its mentions in order of their start; mentions that overlap an earlier one or end beyond the text are left in place."""
    order = F.array_sort(F.transform(F.filter(mentions, lambda m: (m["start"] >= 0) & (m["start"] < m["end"]) & (m["end"] <= F.length(text))), lambda m: F.struct(m["start"].alias("a"), m["end"].alias("b"), m["entity_id"].alias("e"))))
    empty = F.array().cast("array<struct<text: string, entity: string>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def piece(t: Column, e: Column) -> Column:
        return F.filter(F.array(F.struct(t.alias("text"), e.cast("string").alias("entity"))), lambda p: p["text"] != "")

    def step(s: Column, m: Column) -> Column:
        ahead = F.concat(s["out"], piece(F.substr(text, s["at"] + 1, m["a"] - s["at"]), F.lit(None)), piece(F.substr(text, m["a"] + 1, m["b"] - m["a"]), m["e"]))
        return F.when(m["a"] >= s["at"], F.struct(m["b"].alias("at"), ahead.alias("out"))).otherwise(s)

    return F.aggregate(order, start, step, lambda s: F.concat(s["out"], piece(F.substr(text, s["at"] + 1), F.lit(None))))


def verification_lines(rows: DataFrame) -> DataFrame:
    """(id, lines): the context's sentence and each candidate with a mark for the true one, parted by tabs, one candidate a line."""
    one = F.transform("candidate_aspects", lambda a: F.concat_ws("\t", F.when(a["aspect_id"] == F.col("true_aspect"), "*").otherwise(""), a["aspect_id"], a["aspect_name"]))
    return rows.where("error IS NULL").select("id", F.concat_ws("\n", F.concat_ws("\t", "id", "context.target_entity", "context.sentence.content"), F.array_join(one, "\n")).alias("lines"))


def latex(rows: DataFrame) -> DataFrame:
    """(id, context): the paragraph in LaTeX with its mentions in bold."""
    from ..functions.text import escape_latex

    parts = split_text(F.col("context.paragraph.content"), F.col("context.paragraph.entities"))
    marked = F.transform(parts, lambda p: F.when(p["entity"].isNull(), escape_latex(p["text"])).otherwise(F.concat(F.lit("\\textbf{"), escape_latex(p["text"]), F.lit("}"))))
    return rows.where("error IS NULL").select("id", F.array_join(marked, "").alias("context"))
