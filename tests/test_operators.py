"""Reference behaviour on small hand-made inputs."""

import pytest
from helpers import rows
from pyspark.sql import functions as F

from tessellum.functions import text
from tessellum.operators import corpus, dedup, enrich, graph, markup
from tessellum.operators import evaluate as ev
from tessellum.operators.components import connected_components
from tessellum.operators.predicates import Pages, compile_predicate


def test_jaccard_of_toy_paragraphs(spark):
    toy = [("t1", "love hate love hate"), ("t2", "love hate love love"), ("t3", "love chip date love"), ("t4", "chip date love love")]
    sets = spark.createDataFrame(toy, "id string, t string").select("id", text.bigram_set(F.col("t")).alias("set"))
    assert {r["id"]: len(r["set"]) for r in sets.collect()} == {"t1": 2, "t2": 3, "t3": 3, "t4": 3}
    pairs = dedup.similar_sets(sets, "id", "set", 0.4)
    assert [(a, b, round(s, 6)) for a, b, s in rows(pairs)] == [("t1", "t2", round(2 / 3, 6)), ("t3", "t4", 0.5)]
    assert rows(connected_components(pairs)) == [("t1", "t1"), ("t2", "t1"), ("t3", "t3"), ("t4", "t3")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 201), (201, 200), (300, 300), (None, 4)], "a int, b int")
    got = dict(connected_components(edges).collect())
    assert all(got[i] == 0 for i in range(71)) and got[200] == got[201] == 200 and got[300] == 300


def test_redirects_of_three_pages(spark):
    redirects = spark.createDataFrame([("r1", "r2", "S1"), ("r2", "p", None), ("c1", "c2", "x"), ("c2", "c1", None), ("into", "c1", "y")], "id string, dest string, section string")
    closure = enrich.redirect_closure(redirects)
    assert rows(closure) == [("c1", "c1", None), ("c2", "c2", None), ("into", "into", None), ("r1", "p", "S1"), ("r2", "p", None)]
    links = spark.createDataFrame([(1, "a", "r1", "anchor"), (2, "a", "p", "anchor"), (3, "a", "gone", "anchor")], "link_id int, src string, dest string, anchor string")
    fixed = enrich.fix_links(links, closure, spark.createDataFrame([("p",)], "id string"))
    assert rows(fixed.select("link_id", "target", "section", "plain")) == [(1, "p", "S1", False), (2, "p", "anchor", False), (3, "gone", "anchor", True)]


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        ("true", {1, 2, 3}),
        ("name-contains TUR", {1}),
        ("!(name-has-prefix T) & is-redirect", {2}),
        ("name-has-prefix T | name-has-prefix C & is-article | true", {1, 2, 3}),
        ('name-in-set ["New York", Critter]', {2}),
        ("category-contains ANIM", {1}),
        ("category-contains Anim", {1}),
        ("train-set | test-set", {1, 2, 3}),
        ("fold 0 | fold 1 | fold 2 | fold 3 | fold 4", {1, 2, 3}),
        ("page-hash-mod 1 0", {1, 2, 3}),
    ],
)
def test_predicates(spark, predicate, want):
    df = spark.createDataFrame([(1, "Turtle", "article", ["animals"]), (2, "Critter", "redirect", ["Animals"]), (3, "Shell (disambiguation)", "disambiguation", [])], "id int, name string, kind string, cats array<string>")
    if "is-article" in predicate:
        predicate = predicate.replace("is-article", "!is-redirect")
    keep = compile_predicate(predicate, Pages(F.col("name"), F.col("id").cast("string"), F.col("kind"), F.col("cats")))
    assert {r["id"] for r in df.where(keep).collect()} == want


@pytest.mark.parametrize("bad", ["", "(true", "name-contains", "true true", "what", "page-hash-mod 3 5"])
def test_broken_predicates_are_refused(spark, bad):
    with pytest.raises(ValueError):
        compile_predicate(bad, Pages(*[F.col("x")] * 4))


def _tree(spark, data):
    """(id, parent, title) rows to resolved nodes."""
    from tessellum.operators import hierarchy

    rows_ = spark.createDataFrame([(i, t, p, None) for i, p, t in data], "id int, title string, parent int, loaded_at timestamp")
    n = hierarchy.resolve(hierarchy.latest_nodes(rows_)).nodes
    return n.select("id", F.element_at("title_path", -1).alias("title"), "depth", "root", "id_path", "title_path")


def test_subtrees_of_bad_headings_go(spark):
    nodes = _tree(spark, [(1, None, "References"), (2, 1, "References"), (3, 2, "Inner"), (4, 1, "History"), (5, 4, "xy")])
    kept = corpus.drop_subtrees(nodes, lambda t: corpus.bad_heading(t))
    assert [r[0] for r in rows(kept.select("id"))] == [1, 4]
    filled = spark.createDataFrame([(5,)], "id int")
    assert [r[0] for r in rows(corpus.drop_empty(nodes, filled).select("id"))] == [1, 4, 5]


def test_equal_sections_merge_at_every_depth(spark):
    nodes = _tree(spark, [(1, None, "P"), (2, 1, "A"), (3, 1, "A"), (4, 1, "B"), (5, 2, "x"), (6, 3, "x"), (7, 4, "x"), (8, 6, "y"), (9, None, "P"), (10, 9, "A")])
    assert rows(corpus.merge_sections(nodes)) == sorted([(2, 2, 1), (3, 2, 1), (4, 4, 1), (5, 5, 2), (6, 5, 2), (7, 7, 4), (8, 8, 5), (10, 10, 9)], key=repr)


def test_transforms_by_toggle(spark):
    nodes = _tree(spark, [(1, None, "Page"), (2, 1, "History"), (3, 1, "Notes"), (4, 2, "Ab"), (5, 1, "Empty"), (6, 1, "Pictures"), (7, 1, "x" * 101), (8, None, "Short"), (9, 8, "Only one")])
    content = spark.createDataFrame([(1, "lead", "para", True), (2, "a", "para", False), (3, "b", "para", False), (4, "c", "para", False), (6, "i", "image", False), (6, "k", "category", False), (7, "l", "para", False), (9, "o", "para", False)], "node bigint, item string, kind string, lead boolean")
    ids = lambda what: [r[0] for r in rows(corpus.transform_pages(nodes, content, what).select("id"))]
    nothing = dict(lead=False, category_paragraphs=False, images=False, long_headings=False, short_headings=False, headings=(), short_pages=False)
    assert ids(corpus.Transform(**nothing)) == [1, 2, 3, 4, 6, 7, 8, 9]  # the empty section goes
    assert ids(corpus.Transform(**nothing | {"headings": ("notes",)})) == [1, 2, 4, 6, 7, 8, 9]
    assert ids(corpus.Transform(**nothing | {"headings": ("notes",), "fold_case": False})) == [1, 2, 3, 4, 6, 7, 8, 9]
    assert ids(corpus.Transform(**nothing | {"short_headings": True, "long_headings": True})) == [1, 2, 3, 6, 8, 9]
    assert ids(corpus.Transform(**nothing | {"images": True, "category_paragraphs": True})) == [1, 2, 3, 4, 7, 8, 9]
    assert ids(corpus.Transform(**nothing | {"short_pages": True})) == [1, 2, 3, 4, 6, 7]
    assert ids(corpus.Transform(**nothing | {"short_pages": True, "lead": True})) == [1, 2, 3, 4, 6, 7]
    assert ids(corpus.CATEGORIES_AND_HEADINGS) == [1, 2, 8, 9]
    bodies = spark.createDataFrame([("p", "Category:A"), ("p", "Category:B"), ("q", "Category:A"), ("q", None), ("r", "x")], "item string, target string")
    assert rows(corpus.only_links_to(bodies, ["item"], "Category:")) == [("p",)]


def test_pagerank_sums_to_one_and_seeds(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("a", "d", 2)], "src string, dst string, weight int")
    scores = {r["node"]: r["score"] for r in graph.pagerank(edges, 12).collect()}
    assert abs(sum(scores.values()) - 1) < 1e-6 and scores["d"] > scores["b"]
    assert graph.pagerank(edges, 3, jump=spark.createDataFrame([("zz",)], "node string")).count() == 0
    assert rows(graph.distances(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 1)]


def test_agreement_and_correlation(spark):
    same = spark.createDataFrame([(1, 1), (2, 2), (1, 1), (3, 3)], "rel_a int, rel_b int")
    assert ev.cohen_kappa(same).first()["kappa"] == 1.0
    constant = spark.createDataFrame([(1, 1), (1, 1)], "rel_a int, rel_b int")
    assert ev.cohen_kappa(constant).first()["kappa"] is None
    ranks = spark.createDataFrame([("a", 1, 4), ("b", 2, 3), ("c", 3, 2), ("d", 4, 1)], "system string, rank_a int, rank_b int")
    assert ev.kendall_tau(ranks).first()["tau"] == -1.0 and ev.spearman_rho(ranks).first()["rho"] == -1.0
    labels = spark.createDataFrame([(i, g) for i in range(4) for g in (i % 2,) * 3], "item int, label int")
    assert ev.fleiss_kappa(labels, 3).first()["kappa"] == 1.0


PAGE = """{{Infobox river | name = [[Wide|wide one]] | km = 5 }}
A '''bold''' start<ref>gone</ref> with [[turtle#Shell|shells]], {{convert|5|km}} and {{stub}}no stub. <!-- no -->
second line &amp; [http://x.org outside].

== History ==
* first [[a]] item
** inner
=== Early ===
Text.

[[File:x.png|thumb|A [[cap]]tion]]
== Notes ==
[[Category:Rivers]]
"""


def test_markup():
    page, nodes = markup.parse_page("wide_river", PAGE, markup.Config("w"))
    assert page == ("w:Wide%20river", "Wide river", "article", None, ["Rivers"])
    kinds = [(n[4], n[5], n[2], n[9]) for n in nodes]
    assert kinds[0] == ("infobox", "Infobox river", None, "name=wide one; km=5")
    assert kinds[1] == ("para", None, None, "A bold start with shells, 5 km and no stub. second line & outside.")
    assert nodes[1][10] == [("Turtle", "Shell", "w:Turtle", "shells")]
    assert [k[0] for k in kinds[2:]] == ["section", "list", "list", "section", "para", "image", "section"]
    assert kinds[6][2] == 5 and kinds[7][3] == "A caption" and nodes[4][7] == 2
    assert markup.parse_page("R", "#REDIRECT [[animal]]", markup.Config())[0][2:4] == ("redirect", "wiki:Animal")
    assert markup.parse_page("Category:X", None, markup.Config())[0][2] == "category"
    assert markup.parse_page("S (disambiguation)", "", markup.Config()) == (("wiki:S%20(disambiguation)", "S (disambiguation)", "disambiguation", None, []), [])


@pytest.mark.parametrize(
    ("source", "want"),
    [("{{lang|fr|chat}}", "chat"), ("{{lang-de|Hund}}", "Hund"), ("{{as of|2001|May|lc=y}}", "as of May 2001"), ("{{time ago|-3 days}}", "3 days ago"), ("{{angbr|x}}", "⟨x⟩"), ("{{small|{{nowrap|a b}}}}", "a b"), ("{{what|alt=seen}}{{zh|x}}", "seen"), ("{{convert|5}}", "")],
)
def test_templates(source, want):
    assert markup.resolve_templates(source, markup.Config(), []) == want


def test_scalar_functions(spark):
    df = spark.createDataFrame([("Q12x", "ab/c/d", "<dbpedia:New_York>", "wkx:A%20b")], "q string, p string, e string, i string")
    passage, entity = text.passage_and_entity(F.col("p"))
    got = df.select(text.item_number(F.col("q")), passage, entity, text.entity_name(F.col("e")), text.title_of_id(F.col("i")), text.escape_id(F.lit("a b/ü")), text.page_name(F.lit("été"))).first()
    assert tuple(got) == (12, "ab", "c/d", "New York", "A b", "a%20b%2F%C3%BC", "Été")
    chunks = spark.range(1).select(text.overlapping_chunks(F.lit("abcdefghij"), 4, 2).alias("c")).first()["c"]
    assert [tuple(c) for c in chunks] == [(0, "abcdef"), (4, "efghij"), (8, "ij")]


def test_stored_tables_live_in_the_shared_folder(spark, tmp_path, monkeypatch):
    from tessellum import storage

    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(storage, "_stored", {})
    df = storage.materialize(spark.range(3), "t")
    assert df.count() == 3 and len(list(tmp_path.glob("t-*"))) == 1
    storage.release(spark)
    assert not list(tmp_path.glob("t-*"))


def test_shortest_path_scores_against_all_simple_paths(spark):
    import random
    from collections import Counter

    rng = random.Random(2)
    weights = {(f"n{a}", f"n{b}"): float(rng.randint(1, 3)) for a, b in (rng.sample(range(12), 2) for _ in range(40))}
    weights |= {("s", "n0"): 1.0, ("s", "n1"): 1.0, ("n5", "t"): 2.0, ("s", "t"): 1.0, ("t", "c1"): 0.0, ("u", "n3"): 1.0}
    weights |= {(f"c{i}", f"c{i + 1}"): 1.0 for i in range(1, 6)} | {("c6", "u"): 1.0}
    seeds = ["s", "t", "u"]
    edge = {k: max(v, 0.001) for k, v in weights.items() if not (k[0] in seeds and k[1] in seeds)}

    def walks(path, length, end):
        if path[-1] == end:
            yield length, path
            return
        for (a, b), w in edge.items():
            if a == path[-1] and b not in path:
                yield from walks([*path, b], length + w, end)

    inner, total = Counter(), 0
    for a in seeds:
        for b in seeds:
            every = list(walks([a], 0.0, b)) if a != b else []
            best = [p for n, p in every if n == min(n for n, _ in every)]
            total += len(best)
            inner.update(x for p in best for x in p[1:-1])
    got = graph.shortest_path_scores(spark.createDataFrame([(*k, v) for k, v in weights.items()], "src string, dst string, weight double"), spark.createDataFrame([(x,) for x in seeds], "node string"))
    assert {r["node"]: r["score"] for r in got.collect()} == {k: round(n / total, 9) for k, n in inner.items()}
    assert {"c1", "c6", "n0"} <= set(inner) and total > 2


@pytest.mark.parametrize("long_list", [5, 1_000])
def test_list_ranks_of_short_and_long_lists(spark, long_list):
    import random

    from tessellum.operators import ranking

    rng = random.Random(8)
    data = [(rng.choice(["a", "b", None]), float(rng.randint(0, 9)), i) for i in range(300)]
    got = ranking.list_ranks(spark.createDataFrame(data, "g string, s double, i int"), ["g"], [F.desc("s"), F.asc("i")], long_list=long_list)
    want = [(g, s, i, 1 + sum(1 for h, t, j in data if h == g and (-t, j) < (-s, i))) for g, s, i in data]
    assert rows(got.select("g", "s", "i", "rank")) == sorted(want, key=repr)
    assert [r[0] for r in ranking.numbered(spark.range(100).select((99 - F.col("id")).alias("x")), [F.asc("x")]).where("k - 1 <> x").collect()] == []


def test_listed_pages_and_lists_with_links(spark):
    from tessellum.operators import markup
    from tessellum.operators.predicates import keep_listed

    pages = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, page int")
    names = spark.createDataFrame([(" a ",), ("",), ("a",), (None,)], "line string")
    assert rows(keep_listed(pages, "name", names).select("page")) == [(1,)]
    assert rows(keep_listed(pages, "name", names, drop=True).select("page")) == [(2,), (3,)]
    texts = spark.createDataFrame([("T", "Intro.\n\n* [[first]] and [[second]]\n* none")], "title string, text string")
    lists = markup.nodes(texts, "title", "text").where("kind = 'list' AND size(links) > 0").select(F.element_at("links", 1)["target"].alias("t"))
    assert [r[0].lower() for r in lists.collect()] == ["first"]
