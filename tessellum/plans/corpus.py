"""Queries over pages, sections, links and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus as tree
from ..operators import enrich, hierarchy
from ..operators.predicates import Pages, compile_predicate
from ..storage import materialize
from . import base
from .structure import _NODES
from .tables import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """page (the root fragment), page_id, name, page_type, categories (titles of its sections)."""
    f = base.fragments(spark, sf)
    roots = f.where("parent IS NULL").select(F.col("id").alias("page"), "page_id", F.trim(F.coalesce("title", F.lit(""))).alias("name"), "deleted")
    sections = f.where("parent IS NOT NULL AND title IS NOT NULL").groupBy(F.col("parent").alias("page")).agg(F.sort_array(F.collect_set(F.trim("title"))).alias("categories"))
    kind = F.when(F.col("deleted"), "redirect").when(F.col("name").contains("("), "disambiguation").when(F.col("name").startswith("Category"), "category").otherwise("article")
    return roots.join(sections, "page", "left").select("page", "page_id", "name", kind.alias("page_type"), F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


_PAGES = f"""{base.FRAG}, sec AS (SELECT parent AS page, list_sort(list_distinct(list(trim(title, ' ')))) AS categories FROM frag WHERE parent IS NOT NULL AND title IS NOT NULL GROUP BY ALL),
roots AS (SELECT id AS page, page_id, trim(coalesce(title, ''), ' ') AS name, deleted FROM frag WHERE parent IS NULL),
pages AS (SELECT page, page_id, name, CASE WHEN deleted THEN 'redirect' WHEN contains(name, '(') THEN 'disambiguation' WHEN starts_with(name, 'Category') THEN 'category' ELSE 'article' END AS page_type, coalesce(categories, []) AS categories FROM roots LEFT JOIN sec USING (page))"""


def _bucket_sql(n: int, salt: str = "") -> str:
    return f"(('0x' || substr(md5('{salt}' || name), 1, 8))::BIGINT % {n})"


# name: (predicate, its SQL)
PREDICATES = {
    "pred_name_contains": ('name-contains "BR"', "contains(lower(name), 'br')"),
    "pred_name_prefix": ("name-has-prefix K", "starts_with(name, 'K')"),
    "pred_name_suffix": ("name-has-suffix Line", "ends_with(name, 'Line')"),
    "pred_name_in_set": ('name-in-set ["Resith Line", "Yeska Bridge", "Noulk Basin"]', "name IN ('Resith Line', 'Yeska Bridge', 'Noulk Basin')"),
    "pred_pageid_in_set": ('pageid-in-set ["wkx:Orvane%20Basin"]', "page_id IN ('wkx:Orvane%20Basin')"),
    "pred_category_contains": ("category-contains AT", "len(list_filter(categories, lambda c: contains(c, 'at'))) > 0"),
    "pred_hash_mod": ("page-hash-mod 7 3 pepper", f"{_bucket_sql(7, 'pepper')} = 3"),
    "pred_train_set": ("train-set", f"{_bucket_sql(2, 'fold')} = 0"),
    "pred_test_set": ("test-set", f"{_bucket_sql(2, 'fold')} = 1"),
    "pred_fold": ("fold 2", f"{_bucket_sql(10, 'fold')} // 2 = 2"),
    "pred_page_types": ("is-redirect | is-disambiguation | is-category", "page_type IN ('redirect', 'disambiguation', 'category')"),
    "pred_boolean_dsl": ("((name-contains a | name-has-prefix B) & !is-redirect)", "((contains(lower(name), 'a') OR starts_with(name, 'B')) AND NOT page_type = 'redirect')"),
    "pred_left_assoc": ("name-contains a | name-contains b & name-contains c", "((contains(lower(name), 'a') OR contains(lower(name), 'b')) AND contains(lower(name), 'c'))"),
    "pred_from_file": ("category-contains-from-file terms | name-set-from-file names", "(len(list_filter(categories, lambda c: contains(c, 'climate') OR contains(c, 'supply'))) > 0 OR name IN ('Resith Line'))"),
}
FILES = {"terms": ["climate", "supply"], "names": ["Resith Line"]}


def _predicate(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = _pages(spark, sf)
        keep = compile_predicate(PREDICATES[name][0], Pages(F.col("name"), F.col("page_id"), F.col("page_type"), F.col("categories")), FILES.__getitem__)
        return p.where(keep).select("page", "name", "page_type")

    query.__name__ = name
    return query


def name_translate(spark: SparkSession, sf: str) -> DataFrame:
    """Names of pages mapped to the names of the same page under another spelling (the decoded id), identity if missing."""
    index = _pages(spark, sf).where("page_id IS NOT NULL").select("page_id", text.title_of_id(F.regexp_replace("page_id", "~[0-9]+$", "")).alias("other")).groupBy("page_id").agg(F.min("other").alias("other"))
    p = _pages(spark, sf)
    return p.join(index, "page_id", "left").select("page", F.coalesce("other", "name").alias("name"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sections with their paths; ``parent`` is null at roots."""
    n = hierarchy.resolve(hierarchy.latest_nodes(table(spark, sf, "fragments"))).nodes
    return n.select("id", F.when(F.col("depth") > 0, F.element_at("id_path", -2)).alias("parent"), F.element_at("title_path", -1).alias("title"), "depth", "root", "id_path", "title_path")


CATEGORY, CAPTION = "N", 60  # in the test tables: prefix of the targets that stand for categories, most characters of a caption


def _content(spark: SparkSession, sf: str) -> DataFrame:
    """node, item, kind, lead of the placed paragraphs: captions are short texts without a closing mark, category paragraphs have only links to names with CATEGORY."""
    p = base.paragraphs(spark, sf).select(F.col("id").alias("item"), F.trim(F.coalesce("content", F.lit(""))).alias("t"))
    kinds = tree.only_links_to(_bodies(spark, sf), ["item"], CATEGORY).withColumn("links_only", F.lit(True))
    image = (F.length("t") <= CAPTION) & ~F.col("t").rlike("[.!?。]$")
    p = p.join(kinds, "item", "left").select("item", F.when(F.col("links_only"), "category").when(image, "image").otherwise("para").alias("kind"))
    f = base.fragments(spark, sf).select(F.col("id").alias("node"), F.col("parent").isNull().alias("lead"))
    placed = base.placements(spark, sf).select(F.col("fragment").alias("node"), F.col("paragraph_id").alias("item"))
    return placed.join(p, "item").join(f, "node").select(F.col("node").cast("bigint").alias("node"), "item", "kind", "lead")


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    """item, target: the anchors of each paragraph's links (as targets' names)."""
    return base.links(spark, sf).where("paragraph IS NOT NULL").select(F.col("paragraph").alias("item"), F.col("anchor").alias("target"))


_TREE = f"{_NODES}, tnodes AS (SELECT t.id, n.parent, n.title, t.depth, t.root, t.ids, t.path FROM tree t JOIN nodes n USING (id))"
_BAD = "(length(regexp_replace(title, '[^\\p{L}]', '', 'g')) < 3 OR length(title) > 100 OR lower(title) IN (" + ", ".join(f"'{h}'" for h in tree.PLAIN_HEADINGS) + "))"


def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf)
    return n.select("id", "root", "depth", F.array_join("title_path", "/").alias("section_path"))


def outline_stub(spark: SparkSession, sf: str) -> DataFrame:
    """Outlines: sections of a page without content, with their number of direct children."""
    n = _nodes(spark, sf)
    kids = n.where("depth > 0").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))
    return n.join(kids, "id", "left").select("id", "title", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def heading_filters(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf)
    return n.where("depth > 0").select("id", (tree.letters(F.col("title")) < 3).alias("short"), (F.length("title") > 100).alias("long"), F.lower("title").isin(tree.PLAIN_HEADINGS).alias("plain"))


def transform_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections left when bad headings go with all below them."""
    return tree.drop_subtrees(_nodes(spark, sf), lambda t: tree.bad_heading(t)).select("id", "depth", "title")


def _transformed(spark: SparkSession, sf: str, what: tree.Transform) -> DataFrame:
    nodes, content = materialize(_nodes(spark, sf), "nodes"), materialize(_content(spark, sf), "content")
    return tree.transform_pages(nodes, content, what).select("id", "depth", "title")


def transform_full(spark: SparkSession, sf: str) -> DataFrame:
    """Lead, category paragraphs, images, bad headings, then empty sections and short pages go."""
    return _transformed(spark, sf, tree.Transform())


def transform_categories_and_headings(spark: SparkSession, sf: str) -> DataFrame:
    """As transform_full, but leads and short pages stay."""
    return _transformed(spark, sf, tree.CATEGORIES_AND_HEADINGS)


CONFIGURED = tree.Transform(lead=False, images=False, short_headings=False, headings=("History", "Notes"), fold_case=False, short_pages=False)


def transform_configured(spark: SparkSession, sf: str) -> DataFrame:
    """Only category paragraphs, long headings and two headings in their exact writing go."""
    return _transformed(spark, sf, CONFIGURED)


def transformed_content(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraphs that stay in transform_full's headings."""
    return tree.transform_content(_nodes(spark, sf), _content(spark, sf), tree.Transform()).select("node", "item")


def node_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Contents by kind and whether they stand right below the page."""
    return _content(spark, sf).groupBy("kind", "lead").agg(F.count("*").alias("n"))


def category_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of links to categories only."""
    return tree.only_links_to(_bodies(spark, sf), ["item"], CATEGORY)


def top_level_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Contents right below a page go, all others stay."""
    return _content(spark, sf).where("NOT lead").select("node", "item", "kind")


def drop_short_pages(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf)
    top = n.where("depth = 1").groupBy("root").agg(F.count("*").alias("n")).where("n > 3")
    return top.select("root", "n")


def merge_duplicate_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Sections of equal paths as one, with its parent after merging."""
    n = materialize(_nodes(spark, sf), "nodes")
    return tree.merge_sections(n).groupBy("kept", "kept_parent").agg(F.count("*").alias("n_merged"))


def page_metadata_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page", "name", F.lit(None).cast("string").alias("redirect_names"), F.lit(None).cast("string").alias("inlink_ids"))


def lead_text(spark: SparkSession, sf: str) -> DataFrame:
    """The first placed paragraph of every page root."""
    p = base.placements(spark, sf)
    lead = p.groupBy("fragment").agg(F.min_by("paragraph_id", "pf_id").alias("id"))
    roots = base.fragments(spark, sf).where("parent IS NULL").select(F.col("id").alias("fragment"), "title")
    return roots.join(lead, "fragment").join(base.paragraphs(spark, sf), "id").select(F.col("fragment").alias("page"), "title", F.col("content").alias("lead"))


def kb_doc(spark: SparkSession, sf: str) -> DataFrame:
    """Per fragment: paragraphs, links out, length of its text."""
    p = base.placements(spark, sf).join(base.paragraphs(spark, sf).select(F.col("id").alias("paragraph_id"), F.length(F.coalesce("content", F.lit(""))).alias("chars")), "paragraph_id")
    content = p.groupBy(F.col("fragment").alias("id")).agg(F.count("*").alias("n_paragraphs"), F.sum("chars").alias("chars"))
    out = base.links(spark, sf).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dest").alias("n_out"))
    return base.fragments(spark, sf).select("id").join(content, "id", "left").join(out, "id", "left").select("id", F.coalesce("n_paragraphs", F.lit(0)).alias("n_paragraphs"), F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def paragraphs_exploded(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of each fragment in reading order."""
    w = Window.partitionBy("fragment").orderBy("pf_id")
    return base.placements(spark, sf).select("fragment", "paragraph_id", (F.row_number().over(w) - 1).alias("pos"))


def links_view(spark: SparkSession, sf: str) -> DataFrame:
    """Links with the titles of both ends and the text length of their paragraph."""
    f = base.fragments(spark, sf).select("id", "title")
    p = base.paragraphs(spark, sf).select(F.col("id").alias("paragraph"), F.length("content").alias("chars"))
    rows = base.links(spark, sf).join(f.select(F.col("id").alias("src"), F.col("title").alias("src_title")), "src").join(f.select(F.col("id").alias("dest"), F.col("title").alias("dest_title")), "dest").join(p, "paragraph")
    return rows.select("link_id", "src_title", "dest_title", "anchor", "chars")


def fragment_parents(spark: SparkSession, sf: str) -> DataFrame:
    """All ancestors of a fragment, nearest last."""
    n = _nodes(spark, sf).where("depth > 0")
    return n.select("id", F.slice("id_path", 1, F.size("id_path") - 1).alias("parents"))


def fragment_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Sequential numbers of the sections within their page, in order of id."""
    n = _nodes(spark, sf)
    return n.select("id", "root", F.row_number().over(Window.partitionBy("root").orderBy("id")).alias("seq"))


def distinct_on(spark: SparkSession, sf: str) -> DataFrame:
    """One fragment per paragraph: the first placing."""
    return base.placements(spark, sf).groupBy("paragraph_id").agg(F.min_by("fragment", "pf_id").alias("fragment"))


def _redirects(spark: SparkSession, sf: str) -> DataFrame:
    """A fragment whose links all lead to one other fragment forwards to it."""
    one = base.links(spark, sf).groupBy("src").agg(F.count_distinct("dest").alias("n"), F.min("dest").alias("dest"), F.min("anchor").alias("section")).where("n = 1")
    return one.select(F.col("src").alias("id"), "dest", "section")


_REDIR = f"""{base.LINK}, redir AS (SELECT src AS id, min(dest) AS dest, min(anchor) AS section FROM link GROUP BY src HAVING count(DISTINCT dest) = 1),
chain AS (SELECT id, dest, section, [id] AS seen FROM redir
  UNION ALL SELECT c.id, r.dest, coalesce(r.section, c.section), list_append(c.seen, c.dest) FROM chain c JOIN redir r ON r.id = c.dest WHERE NOT list_contains(c.seen, c.dest)),
closure AS (SELECT r.id, coalesce(e.dest, r.id) AS target, e.section FROM redir r LEFT JOIN (SELECT * FROM chain WHERE dest NOT IN (SELECT id FROM redir)) e USING (id))"""


def redirect_closure(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.redirect_closure(_redirects(spark, sf))


def fix_links(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.fix_links(base.links(spark, sf), redirect_closure(spark, sf), base.fragments(spark, sf).select("id"))


_FIXED = f"{_REDIR}, {base.FRAG}, fixed AS (SELECT l.link_id, l.src, l.dest, coalesce(c.target, l.dest) AS target, coalesce(c.section, l.anchor) AS section FROM link l LEFT JOIN closure c ON c.id = l.dest)"


def redirect_names(spark: SparkSession, sf: str) -> DataFrame:
    c = redirect_closure(spark, sf).where("target <> id")
    named = c.join(base.fragments(spark, sf).where("title IS NOT NULL").select("id", "title"), "id")
    return named.groupBy("target").agg(F.sort_array(F.collect_set("title")).alias("names"))


def inlink_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Number of different pages' fragments linking to each target (redirects followed)."""
    return fix_links(spark, sf).where("NOT plain").groupBy("target").agg(F.count_distinct("src").alias("n_inlinks"), F.min("src").alias("first_src"))


def inlink_anchor_hist(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.anchor_histogram(base.links(spark, sf).select(F.col("dest").alias("target"), "anchor"))


def category_tags(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("page", F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n_pages"))


def disambig_names(spark: SparkSession, sf: str) -> DataFrame:
    """For each fragment: titles of the pages whose first link leads to it."""
    first = base.links(spark, sf).groupBy("src").agg(F.min_by("dest", "link_id").alias("dest"))
    named = first.join(base.fragments(spark, sf).where("title IS NOT NULL").select(F.col("id").alias("src"), "title"), "src")
    return named.groupBy("dest").agg(F.sort_array(F.collect_set("title")).alias("names"))


def duplicate_paragraph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that stand under several paragraph ids."""
    p = base.paragraphs(spark, sf).where("content IS NOT NULL")
    return p.groupBy(F.sha1("content").alias("content_id")).agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1")


def duplicate_paragraph_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Contents that stand under several paragraph ids, with every page they are placed in."""
    p = base.paragraphs(spark, sf).where("content IS NOT NULL").select(F.sha1("content").alias("content_id"), F.col("id").alias("paragraph_id"))
    several = p.groupBy("content_id").agg(F.count("*").alias("n")).where("n > 1").select("content_id")
    pages = base.fragments(spark, sf).where("page_id IS NOT NULL").select(F.col("id").alias("fragment"), "page_id")
    rows = p.join(several, "content_id", "left_semi").join(base.placements(spark, sf), "paragraph_id").join(pages, "fragment")
    return rows.groupBy("content_id", "page_id").agg(F.count("*").alias("n"))


def pred_translated_names(spark: SparkSession, sf: str) -> DataFrame:
    """A predicate on names in the other spelling: names are translated first, unknown ones stay."""
    other = name_translate(spark, sf).select("page", F.col("name").alias("other"))
    p = _pages(spark, sf).join(other, "page")
    keep = compile_predicate("name-contains basin & !is-redirect", Pages(F.col("other"), F.col("page_id"), F.col("page_type"), F.col("categories")), FILES.__getitem__)
    return p.where(keep).select("page", "other", "page_type")


def first_wins_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The first page of every page_id, in order of the root."""
    return _pages(spark, sf).where("page_id IS NOT NULL").groupBy("page_id").agg(F.min_by("name", "page").alias("name"), F.min("page").alias("page"))


def bundle_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Links' targets looked up by id, by redirect and by name."""
    names = base.fragments(spark, sf).select("id", "title")
    by_redirect = redirect_closure(spark, sf).select("id", "target")
    return names.join(by_redirect, "id", "left").select("id", F.coalesce("target", "id").alias("resolved"))


# -- judgements ---------------------------------------------------------------------------------


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """The judged paragraphs with the section paths they stand under."""
    n = _nodes(spark, sf)
    return base.placements(spark, sf).join(n.select(F.col("id").cast("int").alias("fragment"), "id_path", "depth"), "fragment").select("paragraph_id", "fragment", "id_path", "depth")


def qrels_hierarchical(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select(F.array_join("id_path", "/").alias("query_id"), F.col("paragraph_id").alias("doc_id"), F.lit(1).alias("rel")).distinct()


def qrels_tree(spark: SparkSession, sf: str) -> DataFrame:
    """A paragraph counts for every section above it, the page included."""
    return _paths(spark, sf).select(F.explode("id_path").alias("query_id"), F.col("paragraph_id").alias("doc_id")).distinct()


def qrels_toplevel(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).where("depth >= 1").select(F.array_join(F.slice("id_path", 1, 2), "/").alias("query_id"), F.col("paragraph_id").alias("doc_id")).distinct()


def qrels_article(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select(F.element_at("id_path", 1).alias("query_id"), F.col("paragraph_id").alias("doc_id")).distinct()


def qrels_rollup_max(spark: SparkSession, sf: str) -> DataFrame:
    """Judgements of a query's page: the highest grade of any of its headings."""
    page = F.regexp_extract("query_id", "^([^/]*)/", 1)
    return base.qrels(spark, sf).select(page.alias("page"), "doc_id", "rel").groupBy("page", "doc_id").agg(F.max("rel").alias("rel"))


def qrels_rollup_levels(spark: SparkSession, sf: str) -> DataFrame:
    q = base.qrels(spark, sf).select(F.regexp_extract("query_id", "^([^/]*)/", 1).alias("page"), "query_id", "rel")
    return q.rollup("page", "query_id").agg(F.count("*").alias("n"), F.max("rel").alias("best"))


def query_derivation(spark: SparkSession, sf: str) -> DataFrame:
    """Section queries: the page title twice, then the headings down to the section."""
    n = _nodes(spark, sf)
    return n.select("id", F.concat_ws(" ", F.element_at("title_path", 1), F.array_join("title_path", " ")).alias("query_text"))


_PATHS = f"{_TREE}, {base.PLACE}, paths AS (SELECT paragraph_id, fragment, ids, depth FROM place JOIN tnodes ON id = fragment)"
_KEPT = f"gone AS (SELECT id FROM tnodes WHERE depth > 0 AND {_BAD}), kept AS (SELECT * FROM tnodes WHERE id NOT IN (SELECT t.id FROM (SELECT id, unnest(ids) AS up FROM tnodes) t JOIN gone g ON g.id = t.up))"

_CONTENT = f"""{base.FRAG}, {base.PARA}, {base.PLACE}, {base.LINK},
only_links AS (SELECT paragraph AS item FROM link WHERE paragraph IS NOT NULL GROUP BY paragraph HAVING bool_and(coalesce(starts_with(anchor, '{CATEGORY}'), false))),
content AS (SELECT CAST(l.fragment AS BIGINT) AS node, p.id AS item, f.parent IS NULL AS lead,
    CASE WHEN o.item IS NOT NULL THEN 'category' WHEN length(trim(coalesce(content, ''), ' ')) <= {CAPTION} AND NOT regexp_matches(trim(coalesce(content, ''), ' '), '[.!?。]$') THEN 'image' ELSE 'para' END AS kind
    FROM place l JOIN para p ON p.id = l.paragraph_id JOIN frag f ON f.id = l.fragment LEFT JOIN only_links o ON o.item = p.id)"""


def _transform_ctes(what: tree.Transform) -> str:
    tests = ["false"]
    tests += ["length(regexp_replace(x, '[^\\p{L}]', '', 'g')) < 3"] if what.short_headings else []
    tests += ["length(x) > 100"] if what.long_headings else []
    tests += [f"{'lower(x)' if what.fold_case else 'x'} IN ({', '.join(repr(h) for h in what.headings)})"] if what.headings else []
    gone = [*(["lead AND kind = 'para'"] if what.lead else []), *(["kind = 'category'"] if what.category_paragraphs else []), *(["kind = 'image'"] if what.images else [])]
    return f"""{_TREE}, {_CONTENT}, fine AS (SELECT id, t.title, t.depth, t.root, t.ids FROM tnodes t JOIN tree USING (id) WHERE len(list_filter(titles[2:], lambda x: {' OR '.join(tests)})) = 0),
        stays AS (SELECT node, item, lead FROM content WHERE node IN (SELECT id FROM fine) AND NOT ({' OR '.join(gone) or 'false'}))"""


def _transform_sql(what: tree.Transform) -> str:
    short = "WHERE root IN (SELECT root FROM (SELECT root FROM kept_ WHERE depth = 1 UNION ALL SELECT node FROM stays WHERE lead) GROUP BY root HAVING count(*) > 3)" if what.short_pages else ""
    return f"""WITH RECURSIVE {_transform_ctes(what)}, up AS (SELECT DISTINCT unnest(ids) AS id FROM fine WHERE id IN (SELECT node FROM stays)),
        kept_ AS (SELECT * FROM fine WHERE depth = 0 OR id IN (SELECT id FROM up)) SELECT id, depth, title FROM kept_ {short}"""


QUERIES = {name: _predicate(name) for name in PREDICATES} | {
    f.__name__: f
    for f in (name_translate, page_sections, outline_stub, heading_filters, transform_sections, transform_full, transform_categories_and_headings, transform_configured, transformed_content, node_kinds, category_paragraphs, top_level_filter, drop_short_pages, merge_duplicate_sections, page_metadata_cleared, lead_text, kb_doc, paragraphs_exploded, links_view, fragment_parents, fragment_ids, distinct_on, redirect_closure, fix_links, redirect_names, inlink_ids, inlink_anchor_hist, category_tags, disambig_names, duplicate_paragraph_counts, duplicate_paragraph_pages, pred_translated_names, first_wins_dedup, bundle_lookup, qrels_hierarchical, qrels_tree, qrels_toplevel, qrels_article, qrels_rollup_max, qrels_rollup_levels, query_derivation)
}

SQL = {name: f"WITH {_PAGES} SELECT page, name, page_type FROM pages WHERE {sql}" for name, (_, sql) in PREDICATES.items()} | {
    "name_translate": f"WITH {_PAGES}, idx AS (SELECT page_id, min(url_decode(regexp_replace(regexp_replace(page_id, '~[0-9]+$', ''), '^[^:]*:', ''))) AS other FROM pages WHERE page_id IS NOT NULL GROUP BY ALL) SELECT page, coalesce(other, name) AS name FROM pages LEFT JOIN idx USING (page_id)",
    "page_sections": f"WITH RECURSIVE {_TREE.replace(' / ', '/')} SELECT id, root, depth, path AS section_path FROM tnodes",
    "outline_stub": f"WITH RECURSIVE {_TREE} SELECT t.id, title, depth, coalesce(n, 0) AS n_children FROM tnodes t LEFT JOIN (SELECT parent, count(*) AS n FROM tnodes WHERE depth > 0 GROUP BY ALL) k ON k.parent = t.id",
    "heading_filters": f"WITH RECURSIVE {_TREE} SELECT id, length(regexp_replace(title, '[^\\p{{L}}]', '', 'g')) < 3 AS short, length(title) > 100 AS long, lower(title) IN ({', '.join(repr(h) for h in tree.PLAIN_HEADINGS)}) AS plain FROM tnodes WHERE depth > 0",
    "transform_sections": f"WITH RECURSIVE {_TREE}, {_KEPT} SELECT id, depth, title FROM kept",
    "transform_full": _transform_sql(tree.Transform()),
    "transform_categories_and_headings": _transform_sql(tree.CATEGORIES_AND_HEADINGS),
    "transform_configured": _transform_sql(CONFIGURED),
    "transformed_content": f"WITH RECURSIVE {_transform_ctes(tree.Transform())} SELECT node, item FROM stays",
    "node_kinds": f"WITH {_CONTENT} SELECT kind, lead, count(*) AS n FROM content GROUP BY ALL",
    "category_paragraphs": f"WITH {_CONTENT} SELECT item FROM only_links",
    "top_level_filter": f"WITH {_CONTENT} SELECT node, item, kind FROM content WHERE NOT lead",
    "drop_short_pages": f"WITH RECURSIVE {_TREE} SELECT root, count(*) AS n FROM tnodes WHERE depth = 1 GROUP BY root HAVING count(*) > 3",
    "merge_duplicate_sections": f"""WITH RECURSIVE {_NODES}, k AS (SELECT root, titles, min(id) AS kept, count(*) AS n FROM tree WHERE depth > 0 GROUP BY root, titles)
        SELECT k.kept, coalesce(u.kept, k.root) AS kept_parent, k.n AS n_merged FROM k LEFT JOIN k u ON u.root = k.root AND u.titles = k.titles[:-2]""",
    "page_metadata_cleared": f"WITH {_PAGES} SELECT page, name, CAST(NULL AS VARCHAR) AS redirect_names, CAST(NULL AS VARCHAR) AS inlink_ids FROM pages",
    "lead_text": f"WITH {base.FRAG}, {base.PARA}, {base.PLACE}, lead AS (SELECT fragment, arg_min(paragraph_id, pf_id) AS id FROM place GROUP BY ALL) SELECT f.id AS page, f.title, p.content AS lead FROM frag f JOIN lead l ON l.fragment = f.id JOIN para p ON p.id = l.id WHERE f.parent IS NULL",
    "kb_doc": f"""WITH {base.FRAG}, {base.PARA}, {base.PLACE}, {base.LINK}, c AS (SELECT fragment AS id, count(*) AS n_paragraphs, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS chars FROM place JOIN para ON para.id = place.paragraph_id GROUP BY ALL),
        o AS (SELECT src AS id, count(DISTINCT dest) AS n_out FROM link GROUP BY ALL) SELECT id, coalesce(n_paragraphs, 0) AS n_paragraphs, coalesce(chars, 0) AS chars, coalesce(n_out, 0) AS n_out FROM frag LEFT JOIN c USING (id) LEFT JOIN o USING (id)""",
    "paragraphs_exploded": f"WITH {base.PLACE} SELECT fragment, paragraph_id, CAST(row_number() OVER (PARTITION BY fragment ORDER BY pf_id) - 1 AS INTEGER) AS pos FROM place",
    "links_view": f"WITH {base.FRAG}, {base.PARA}, {base.LINK} SELECT link_id, a.title AS src_title, b.title AS dest_title, anchor, CAST(length(content) AS INTEGER) AS chars FROM link JOIN frag a ON a.id = src JOIN frag b ON b.id = dest JOIN para p ON p.id = paragraph",
    "fragment_parents": f"WITH RECURSIVE {_TREE} SELECT id, ids[:-2] AS parents FROM tnodes WHERE depth > 0",
    "fragment_ids": f"WITH RECURSIVE {_TREE} SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY id) AS seq FROM tnodes",
    "distinct_on": f"WITH {base.PLACE} SELECT DISTINCT ON (paragraph_id) paragraph_id, fragment FROM place ORDER BY paragraph_id, pf_id",
    "redirect_closure": f"WITH RECURSIVE {_REDIR} SELECT id, target, section FROM closure",
    "fix_links": f"WITH RECURSIVE {_FIXED} SELECT link_id, src, dest, target, section, target NOT IN (SELECT id FROM frag) AS plain FROM fixed",
    "redirect_names": f"WITH RECURSIVE {_REDIR}, {base.FRAG} SELECT target, list_sort(list(DISTINCT title)) AS names FROM closure JOIN frag USING (id) WHERE target <> id AND title IS NOT NULL GROUP BY target",
    "inlink_ids": f"WITH RECURSIVE {_FIXED} SELECT target, count(DISTINCT src) AS n_inlinks, min(src) AS first_src FROM fixed WHERE target IN (SELECT id FROM frag) GROUP BY target",
    "inlink_anchor_hist": f"WITH {base.LINK}, n AS (SELECT dest AS target, anchor, count(*) AS n FROM link WHERE anchor IS NOT NULL GROUP BY ALL) SELECT target, list(anchor || '=' || n ORDER BY n DESC, anchor) AS anchors FROM n GROUP BY target",
    "category_tags": f"WITH {_PAGES} SELECT category, count(*) AS n_pages FROM (SELECT unnest(categories) AS category FROM pages) GROUP BY ALL",
    "disambig_names": f"WITH {base.LINK}, {base.FRAG}, f AS (SELECT src, arg_min(dest, link_id) AS dest FROM link GROUP BY ALL) SELECT dest, list_sort(list(DISTINCT title)) AS names FROM f JOIN frag ON frag.id = src WHERE title IS NOT NULL GROUP BY dest",
    "duplicate_paragraph_counts": f"WITH {base.PARA} SELECT sha1(content) AS content_id, count(*) AS n, min(id) AS first_id FROM para WHERE content IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_paragraph_pages": f"WITH {base.PARA}, {base.FRAG}, {base.PLACE}, h AS (SELECT id, sha1(content) AS content_id FROM para WHERE content IS NOT NULL) SELECT content_id, page_id, count(*) AS n FROM h JOIN place ON paragraph_id = h.id JOIN frag f ON f.id = fragment WHERE page_id IS NOT NULL AND content_id IN (SELECT content_id FROM h GROUP BY content_id HAVING count(*) > 1) GROUP BY ALL",
    "pred_translated_names": f"WITH {_PAGES}, idx AS (SELECT page_id, min(url_decode(regexp_replace(regexp_replace(page_id, '~[0-9]+$', ''), '^[^:]*:', ''))) AS other FROM pages WHERE page_id IS NOT NULL GROUP BY ALL), t AS (SELECT page, page_type, coalesce(other, name) AS other FROM pages LEFT JOIN idx USING (page_id)) SELECT page, other, page_type FROM t WHERE contains(lower(other), 'basin') AND page_type <> 'redirect'",
    "first_wins_dedup": f"WITH {_PAGES} SELECT page_id, arg_min(name, page) AS name, min(page) AS page FROM pages WHERE page_id IS NOT NULL GROUP BY page_id",
    "bundle_lookup": f"WITH RECURSIVE {_REDIR}, {base.FRAG} SELECT id, coalesce(target, id) AS resolved FROM frag LEFT JOIN closure USING (id)",
    "qrels_hierarchical": f"WITH RECURSIVE {_PATHS} SELECT DISTINCT array_to_string(ids, '/') AS query_id, paragraph_id AS doc_id, 1 AS rel FROM paths",
    "qrels_tree": f"WITH RECURSIVE {_PATHS} SELECT DISTINCT unnest(ids) AS query_id, paragraph_id AS doc_id FROM paths",
    "qrels_toplevel": f"WITH RECURSIVE {_PATHS} SELECT DISTINCT array_to_string(ids[:2], '/') AS query_id, paragraph_id AS doc_id FROM paths WHERE depth >= 1",
    "qrels_article": f"WITH RECURSIVE {_PATHS} SELECT DISTINCT ids[1] AS query_id, paragraph_id AS doc_id FROM paths",
    "qrels_rollup_max": f"WITH {base.QREL} SELECT regexp_extract(query_id, '^([^/]*)/', 1) AS page, doc_id, max(rel) AS rel FROM qrel GROUP BY ALL",
    "qrels_rollup_levels": f"WITH {base.QREL}, q AS (SELECT regexp_extract(query_id, '^([^/]*)/', 1) AS page, query_id, rel FROM qrel) SELECT page, query_id, count(*) AS n, max(rel) AS best FROM q GROUP BY ROLLUP (page, query_id)",
    "query_derivation": f"WITH RECURSIVE {_TREE.replace(' / ', ' ')}, r AS (SELECT id, title FROM tnodes WHERE depth = 0) SELECT t.id, concat_ws(' ', r.title, t.path) AS query_text FROM tnodes t JOIN r ON r.id = t.root",
}
