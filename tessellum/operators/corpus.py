"""Tree and content transforms of pages, as joins over node tables.

A node table has (id, parent, title, depth, id_path, title_path); ``hierarchy.resolve`` makes it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of sections without running text, lower case.
PLAIN_HEADINGS = [
    "see also", "references", "external links", "notes", "bibliography", "gallery", "publications", "further reading", "track listing", "sources",
    "cast", "discography", "awards", "other", "external links and references", "notes and references",
]


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def bad_heading(title: Column, least: int = 3, most: int = 100, forbidden: list[str] = PLAIN_HEADINGS) -> Column:
    return (letters(title) < least) | (F.length(title) > most) | F.lower(title).isin(forbidden)


def drop_subtrees(nodes: DataFrame, bad: Callable[[Column], Column]) -> DataFrame:
    """Nodes without a bad heading on their path; roots stay. Paths hold the headings, so nothing is joined."""
    return nodes.where(~F.exists(F.slice("title_path", 2, F.greatest(F.size("title_path") - 1, F.lit(0))), bad))


def drop_empty(nodes: DataFrame, filled: DataFrame) -> DataFrame:
    """Nodes with content of their own or below them; ``filled``: ids of the nodes with content. Roots stay."""
    kept = nodes.join(filled, "id", "left_semi").select(F.explode("id_path").alias("id")).distinct()
    return nodes.join(kept.withColumn("full", F.lit(True)), "id", "left").where("full OR depth = 0").drop("full")


def merge_sections(nodes: DataFrame) -> DataFrame:
    """(id, kept, kept_parent): sections of equal headings under the same parent become one, named by the smallest id.

    Children move to the one that stays and merge with its own, at every depth: two sections
    are one exactly if their paths of headings are equal.
    """
    key = lambda path: F.sha2(F.to_json(F.struct(path.alias("p"))), 256)
    keyed = nodes.where("depth > 0").select("id", "root", "depth", key(F.col("title_path")).alias("k"), key(F.slice("title_path", 1, F.size("title_path") - 1)).alias("up"))
    kept = keyed.groupBy("root", "k").agg(F.min("id").alias("kept"))
    above = kept.select("root", F.col("k").alias("up"), F.col("kept").alias("kept_parent"))
    return keyed.join(kept, ["root", "k"]).join(above, ["root", "up"], "left").select("id", "kept", F.coalesce("kept_parent", "root").alias("kept_parent"))


@dataclass(frozen=True)
class Transform:
    """What is dropped from pages; ``headings`` are compared in lower case if ``fold_case``."""

    lead: bool = True  # paragraphs before the first section
    category_paragraphs: bool = True  # paragraphs of links to categories only
    images: bool = True
    long_headings: bool = True
    short_headings: bool = True
    headings: tuple[str, ...] = tuple(PLAIN_HEADINGS)
    fold_case: bool = True
    short_pages: bool = True  # pages of up to three nodes right below the page

    def bad(self, title: Column) -> Column:
        tests = [F.lit(False)]
        tests += [letters(title) < 3] if self.short_headings else []
        tests += [F.length(title) > 100] if self.long_headings else []
        tests += [(F.lower(title) if self.fold_case else title).isin(list(self.headings))] if self.headings else []
        return functools.reduce(lambda a, b: a | b, tests)


CATEGORIES_AND_HEADINGS = Transform(lead=False, short_pages=False)


def transform_content(nodes: DataFrame, content: DataFrame, what: Transform) -> DataFrame:
    """Content (node, item, kind, lead) that stays: its own kind is kept and no heading above it is bad.

    ``kind``: para, category or image; ``lead``: whether it stands right below the page.
    """
    stays = content
    if what.lead:
        stays = stays.where("NOT lead OR kind <> 'para'")
    if what.category_paragraphs:
        stays = stays.where("kind <> 'category'")
    if what.images:
        stays = stays.where("kind <> 'image'")
    return stays.join(drop_subtrees(nodes, what.bad).select(F.col("id").alias("node")), "node", "left_semi")


def transform_pages(nodes: DataFrame, content: DataFrame, what: Transform) -> DataFrame:
    """Sections that stay: no bad heading on the path, something left below them, and the page not too short."""
    left = transform_content(nodes, content, what)
    kept = drop_empty(drop_subtrees(nodes, what.bad), left.select(F.col("node").alias("id")).distinct())
    if not what.short_pages:
        return kept
    top = kept.where("depth = 1").select("root").unionByName(left.where("lead").select(F.col("node").alias("root")))
    return kept.join(top.groupBy("root").agg(F.count("*").alias("n")).where("n > 3").select("root"), "root", "left_semi")


def only_links_to(bodies: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """(keys): items whose every body is a link to a name with ``prefix``; ``bodies``: keys, target (null for text)."""
    ok = F.bool_and(F.coalesce(F.col("target").startswith(prefix), F.lit(False)))
    return bodies.groupBy(*keys).agg(ok.alias("ok")).where("ok").select(*keys)
