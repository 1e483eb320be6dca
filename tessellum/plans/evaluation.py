"""Evaluation, agreement, assessment state and learning features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assess
from ..operators import evaluate as ev
from ..operators import learning, ranking
from ..storage import materialize
from . import base
from .retrieval import run_order, run_ranked
from .tables import table

R9 = lambda c: F.round(c, 9)


def _relevant(spark: SparkSession, sf: str) -> DataFrame:
    return base.qrels(spark, sf).where("rel > 0").select("query_id", "doc_id")


def _shared_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of the judged queries only: the semi join keeps the windows small."""
    judged = _relevant(spark, sf).select("query_id").distinct()
    return ranking.list_ranks(materialize(base.runs(spark, sf).join(judged, "query_id", "left_semi"), "runs"), ["query_id", "method"], run_order())


def map_score(spark: SparkSession, sf: str) -> DataFrame:
    ap = ev.average_precision(_shared_runs(spark, sf), _relevant(spark, sf), ["method"])
    return ap.groupBy("method").agg(F.count("*").alias("n"), F.round(F.avg("ap"), 9).alias("map"))


def average_precisions(spark: SparkSession, sf: str) -> DataFrame:
    return ev.average_precision(_shared_runs(spark, sf), _relevant(spark, sf), ["method"]).withColumn("ap", R9("ap"))


def prf1_at_5(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.precision_recall(_shared_runs(spark, sf), _relevant(spark, sf), ["method"], 5)
    return out.select("query_id", "method", *[R9(c).alias(c) for c in ("precision", "recall", "f1")])


def prf1_avg(spark: SparkSession, sf: str) -> DataFrame:
    out = ev.precision_recall(_shared_runs(spark, sf), _relevant(spark, sf), ["method"], 5)
    return out.groupBy("method").agg(*[F.round(F.avg(c), 9).alias(c) for c in ("precision", "recall", "f1")])


def mean_stderr_table(spark: SparkSession, sf: str) -> DataFrame:
    ap = ev.average_precision(_shared_runs(spark, sf), _relevant(spark, sf), ["method"])
    return ap.groupBy("method").agg(F.round(F.avg("ap"), 9).alias("mean"), F.round(F.stddev_pop("ap") / F.sqrt(F.count("*")), 9).alias("stderr"))


def _system_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Methods ranked by MAP and by mean precision at five."""
    a = map_score(spark, sf).select(F.col("method").alias("system"), F.col("map").alias("a"))
    b = prf1_avg(spark, sf).select(F.col("method").alias("system"), F.col("precision").alias("b"))
    rank = lambda c: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(c), "system"))
    return a.join(b, "system").select("system", rank("a").alias("rank_a"), rank("b").alias("rank_b"))  # a handful of systems


def system_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return _system_ranks(spark, sf)


def kendall_tau(spark: SparkSession, sf: str) -> DataFrame:
    return ev.kendall_tau(_system_ranks(spark, sf)).withColumn("tau", R9("tau"))


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return ev.spearman_rho(_system_ranks(spark, sf)).withColumn("rho", R9("rho"))


def cronbach_alpha(spark: SparkSession, sf: str) -> DataFrame:
    """Over queries that at least three methods answer: the methods that answer all of those of the commonest set."""
    ap = materialize(ev.average_precision(_shared_runs(spark, sf), _relevant(spark, sf), ["method"]), "precisions")
    sets = ap.groupBy("query_id").agg(F.sort_array(F.collect_set("method")).alias("methods")).where(F.size("methods") >= 3)
    common = sets.groupBy("methods").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.array_join("methods", ",")).limit(1).select("methods")
    full = sets.join(F.broadcast(common), "methods").select("query_id")  # one row
    return ev.cronbach_alpha(ap.join(full, "query_id", "left_semi").select("query_id", F.col("method").alias("system"), F.col("ap").alias("value"))).withColumn("alpha", F.round("alpha", 6))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _label_pairs(spark, sf).groupBy("rel_a", "rel_b").agg(F.count("*").alias("n"))


def _label_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two assessors' labels of the same item, each unordered pair once; few assessors label an item."""
    j = base.judgements(spark, sf)
    a, b = j.select("query_id", "doc_id", F.col("assessor").alias("a"), F.col("rel").alias("rel_a")), j.select("query_id", "doc_id", F.col("assessor").alias("b"), F.col("rel").alias("rel_b"))
    return a.join(b, ["query_id", "doc_id"]).where("a < b")


def cohen_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return ev.cohen_kappa(_label_pairs(spark, sf), keys=("a", "b")).withColumn("kappa", R9("kappa"))


def cohen_kappa_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring grades count as one: labels cut at 1."""
    cut = lambda c: (F.col(c) >= 1).cast("int")
    return ev.cohen_kappa(_label_pairs(spark, sf).select(cut("rel_a").alias("rel_a"), cut("rel_b").alias("rel_b"))).withColumn("kappa", R9("kappa"))


def fleiss_kappa(spark: SparkSession, sf: str) -> DataFrame:
    items = base.judgements(spark, sf).select(F.struct("query_id", "doc_id").alias("item"), F.col("rel").alias("label"))
    return ev.fleiss_kappa(items, 3).withColumn("kappa", R9("kappa"))


def qrel_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Items that two assessors both judged, per pair."""
    return _label_pairs(spark, sf).groupBy("a", "b").agg(F.count("*").alias("n_both"), F.sum((F.col("rel_a") == F.col("rel_b")).cast("int")).alias("n_same"))


def assessor_counts(spark: SparkSession, sf: str) -> DataFrame:
    return base.judgements(spark, sf).groupBy("assessor").agg(F.count("*").alias("n"), F.sum((F.col("rel") > 0).cast("int")).alias("n_positive"))


def seconds_per_assessment(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds between the first and last judgement of an assessor, per judgement after the first."""
    t = F.unix_timestamp("ts")
    rows = base.judgements(spark, sf).groupBy("assessor").agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("span"))
    return rows.select("assessor", "n", F.round(ev.safe_ratio(F.col("span"), F.col("n") - 1), 6).alias("seconds"))


def new_assessments(spark: SparkSession, sf: str) -> DataFrame:
    """Items first judged in each month: those judged before do not count again."""
    first = base.judgements(spark, sf).groupBy("query_id", "doc_id").agg(F.min("ts").alias("ts"))
    return first.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def qrel_binary(spark: SparkSession, sf: str) -> DataFrame:
    return base.qrels(spark, sf).select("query_id", "doc_id", F.when(F.col("rel") < 2, 0).otherwise(1).alias("rel"))


def qrel_augment(spark: SparkSession, sf: str) -> DataFrame:
    """Run items with their grade; unjudged ones count as not relevant."""
    r = base.runs(spark, sf).where("method = 'bm25'").select("query_id", "doc_id")
    return r.join(base.qrels(spark, sf), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("rel", F.lit(0)).alias("rel"))


def qrel_drop_unjudged(spark: SparkSession, sf: str) -> DataFrame:
    r = base.runs(spark, sf).where("method = 'bm25'").select("query_id", "doc_id", "score")
    return r.join(base.qrels(spark, sf), ["query_id", "doc_id"])


def qrel_pad_full(spark: SparkSession, sf: str) -> DataFrame:
    """Placed paragraphs as automatic judgements, padded by manual ones with 0, both kept."""
    manual = base.qrels(spark, sf).select("doc_id", "rel").groupBy("doc_id").agg(F.max("rel").alias("manual"))
    auto = base.placements(spark, sf).select(F.col("paragraph_id").alias("doc_id")).distinct().withColumn("auto", F.lit(1))
    return manual.join(auto, "doc_id", "full").select("doc_id", F.coalesce("auto", F.lit(0)).alias("auto"), "manual")


# -- assessment state ------------------------------------------------------------------------------


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "assessments").select("query_id", "paragraph_id", "facet_id", "session_id", "relevance", "time_stamp").distinct()


_STATE = "state AS (SELECT DISTINCT query_id, paragraph_id, facet_id, session_id, relevance, time_stamp FROM assessments)"
_META = "meta AS (SELECT session_id, min(time_stamp) AS meta_ts, list_sort(list_distinct(flatten(list(coalesce(run_ids, []))))) AS run_ids FROM assessment_metadata GROUP BY session_id)"


def _meta(spark: SparkSession, sf: str) -> DataFrame:
    empty = F.array().cast("array<string>")
    return table(spark, sf, "assessment_metadata").groupBy("session_id").agg(F.min("time_stamp").alias("meta_ts"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.coalesce("run_ids", empty))))).alias("run_ids"))


def assess_merge_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest label per query, paragraph and facet; later sessions win ties."""
    return assess.latest(_state(spark, sf).where("relevance IS NOT NULL"), ["query_id", "paragraph_id", "facet_id"], "time_stamp", "session_id", "relevance")


def assess_filter_time(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).where("time_stamp > timestamp'2025-09-01 00:00:00'")


def assess_filter_run(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of sessions that looked at one of two runs."""
    wanted = F.array(F.lit("run-ltr"), F.lit("run-cosine"))
    sessions = _meta(spark, sf).where(F.arrays_overlap("run_ids", wanted)).select("session_id")
    return _state(spark, sf).join(sessions, "session_id", "left_semi").select("query_id", "paragraph_id", "session_id", "relevance")


def assess_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Drops rows with neither facet nor label; unset labels of a facet become 2."""
    return _state(spark, sf).where("facet_id IS NOT NULL OR relevance IS NOT NULL").select("query_id", "paragraph_id", F.coalesce("facet_id", F.lit("none")).alias("facet_id"), "session_id", F.coalesce("relevance", F.lit(2)).alias("relevance"))


def assess_anonymize(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).select("query_id", "paragraph_id", "facet_id", "relevance", F.lit("session").alias("session_id"), F.lit("assessor").alias("assessor"))


def assess_merge_annotators(spark: SparkSession, sf: str) -> DataFrame:
    """Across assessors: the alphabetically first one wins, then the later date."""
    j = base.judgements(spark, sf)
    first = j.groupBy("query_id", "doc_id").agg(F.min("assessor").alias("assessor"))
    return j.join(first, ["query_id", "doc_id", "assessor"]).select("query_id", "doc_id", "assessor", "rel")


def assess_first_file_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Left-biased union of sessions in order of their id."""
    s = _state(spark, sf).where("relevance IS NOT NULL")
    return s.groupBy("query_id", "paragraph_id").agg(F.min(F.struct("session_id", F.coalesce("facet_id", F.lit("")).alias("f"), "time_stamp", "relevance")).alias("m")).select("query_id", "paragraph_id", "m.session_id", "m.relevance")


def assess_run_union(spark: SparkSession, sf: str) -> DataFrame:
    """All run ids that stand behind a query's labels."""
    rows = _state(spark, sf).select("query_id", "session_id").distinct().join(_meta(spark, sf), "session_id")
    return rows.select("query_id", F.explode("run_ids").alias("r")).groupBy("query_id").agg(F.sort_array(F.collect_set("r")).alias("run_ids"))


def assessments_to_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Section-level and page-level judgements of the merged state in one table."""
    m = assess_merge_latest(spark, sf)
    section = m.where("facet_id IS NOT NULL").select(F.concat_ws("/", "query_id", "facet_id").alias("query_id"), F.col("paragraph_id").alias("doc_id"), F.col("relevance").alias("rel"), F.lit("section").alias("level"))
    page = m.groupBy("query_id", F.col("paragraph_id").alias("doc_id")).agg(F.max("relevance").alias("rel")).withColumn("level", F.lit("page"))
    return section.unionByName(page)


def grade_remap(spark: SparkSession, sf: str) -> DataFrame:
    """Grades mapped to a scale of 0..2; those without a mapping stay."""
    to = F.create_map(*[F.lit(x) for kv in ((-2, 0), (2, 1), (3, 2)) for x in kv])
    return base.qrels(spark, sf).select("query_id", "doc_id", F.coalesce(F.element_at(to, F.col("rel")), F.col("rel")).alias("rel"))


def label_to_grade(spark: SparkSession, sf: str) -> DataFrame:
    s = _state(spark, sf)
    return s.select(assess.label_of(F.col("relevance")).alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("grade", assess.grade_of(F.col("label")))


def missing_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: paragraphs whose labels are all unset, and paragraphs without any facet."""
    p = _state(spark, sf).groupBy("query_id", "paragraph_id").agg(F.count("relevance").alias("n_set"), F.count("facet_id").alias("n_facet"))
    return p.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("n_set") == 0).alias("n_unset"), F.count_if(F.col("n_facet") == 0).alias("n_no_facet"))


def _page_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A query's judged paragraphs in order of time, with the latest facet."""
    m = assess_merge_latest(spark, sf)
    rows = m.groupBy("query_id", "paragraph_id").agg(F.max(F.struct("time_stamp", F.coalesce("facet_id", F.lit("")).alias("facet"), "relevance")).alias("r"))
    return rows.select("query_id", "paragraph_id", "r.time_stamp", "r.facet", "r.relevance")


def page_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per query: share of neighbours with the same facet, and mean relevance of 0..1."""
    n = assess.neighbours(_page_rows(spark, sf), ["query_id"], ["time_stamp", "paragraph_id"], "facet")
    same = F.avg(F.when(F.col("previous").isNotNull(), (F.col("previous") == F.col("facet")).cast("double")))
    return n.groupBy("query_id").agg(F.round(F.coalesce(same, F.lit(0.0)), 9).alias("facet_overlap"), F.round(F.avg(F.greatest("relevance", F.lit(0)) / 3), 9).alias("relevance"))


def repair_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions between the paragraphs left when trash is hidden."""
    visible = _page_rows(spark, sf).where("relevance >= 0")
    return assess.neighbours(visible, ["query_id"], ["time_stamp", "paragraph_id"], "paragraph_id").where("previous IS NOT NULL").select("query_id", F.col("previous").alias("paragraph_id1"), F.col("paragraph_id").alias("paragraph_id2"))


def restricted(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows of the values asked for; an empty choice means all."""
    return rows.where(F.col(column).isin(values)) if values else rows


def chosen(rows: DataFrame, id_col: str, ids: list[str], name_col: str, names: list[str]) -> DataFrame:
    """Rows chosen by id or name; without any choice all."""
    if not ids and not names:
        return rows
    return rows.where(F.col(id_col).isin(ids) | F.col(name_col).isin(names))


# -- learning ------------------------------------------------------------------------------------------

def _methods(spark: SparkSession, sf: str) -> list[str]:
    """The registered methods in order of their names."""
    return sorted(r["method"] for r in table(spark, sf, "ranking_methods").collect())


def run_features_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Reciprocal rank of each method per query and item, 0 where absent; one row for each method."""
    methods = table(spark, sf, "ranking_methods").select("method")
    ranked = run_ranked(spark, sf).join(F.broadcast(methods), "method", "left_semi")
    items = ranked.select("query_id", "doc_id").distinct().crossJoin(F.broadcast(methods))  # a few methods
    r = items.join(ranked, ["query_id", "doc_id", "method"], "left")
    return r.select("query_id", "doc_id", "method", F.round(F.coalesce(1 / F.col("rank"), F.lit(0.0)), 9).alias("reciprocal"))


def _feature_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """(query_id, doc_id, features): reciprocal ranks of all registered methods."""
    methods = _methods(spark, sf)
    r = run_ranked(spark, sf).groupBy("query_id", "doc_id").pivot("method", methods).agg(F.first(1 / F.col("rank")))
    return r.select("query_id", "doc_id", F.array(*[F.coalesce(F.col(m), F.lit(0.0)) for m in methods]).alias("features")), methods


def run_feature_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = run_ranked(spark, sf)
    return r.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_runs"), F.round(F.sum(1 / F.col("rank")), 9).alias("sum_rr"), F.min("rank").alias("best_rank"))


def zscore_features(spark: SparkSession, sf: str) -> DataFrame:
    """Scores against the mean and deviation of their method; one row a method is joined back."""
    r = base.runs(spark, sf)
    stats = r.groupBy("method").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return r.join(stats, "method").select("query_id", "doc_id", "method", F.round((F.col("score") - F.col("m")) / F.col("s"), 6).alias("z"))


def posify_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Positive edge weights from scores: exponential (plain and of the score over the query's deviation), logistic, cut at 0, above the minimum."""
    r = base.runs(spark, sf).where("method = 'ltr'")
    low = r.groupBy("query_id").agg(F.min("score").alias("low"), F.stddev_pop("score").alias("s"))
    kinds = {k: learning.positive_weight(F.col("score"), k, F.col("low"), F.coalesce(F.col("score") / F.nullif("s", F.lit(0.0)), F.lit(0.0))) for k in ("exp", "denormal-exp", "logistic", "cut", "linear")}
    names = {"exp": "exponential", "denormal-exp": "denormal"}
    return r.join(low, "query_id").select("query_id", "doc_id", *[F.round(c, 6).alias(names.get(k, k)) for k, c in kinds.items()])


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    """As many irrelevant as relevant judgements, drawn by hash: the smaller class is kept whole."""
    q = base.qrels(spark, sf).select("query_id", "doc_id", (F.col("rel") > 0).cast("int").alias("label"))
    return learning.balanced(materialize(q, "labels"), ["query_id", "doc_id"]).select("query_id", "doc_id", "label")


def pair_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Training pairs: a heading and a paragraph that stands under it."""
    f = base.fragments(spark, sf).where("title IS NOT NULL").select(F.col("id").alias("fragment"), "title")
    return base.placements(spark, sf).join(f, "fragment").select(F.lit(1).alias("label"), "fragment", "paragraph_id", "title")


def pair_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Training pairs: a paragraph with the second next of its fragment (1), and with the first of the page's next fragment (0)."""
    p = base.placements(spark, sf).join(base.fragments(spark, sf).where("page_id IS NOT NULL").select(F.col("id").alias("fragment"), "page_id"), "fragment")
    pos = p.withColumn("id2", F.lead("paragraph_id", 2).over(Window.partitionBy("fragment").orderBy("pf_id"))).where("id2 IS NOT NULL")
    first = p.groupBy("page_id", "fragment").agg(F.min_by("paragraph_id", "pf_id").alias("first"))
    nxt = first.select("fragment", F.lead("first").over(Window.partitionBy("page_id").orderBy("fragment")).alias("id2")).where("id2 IS NOT NULL")
    neg = p.join(nxt, "fragment")
    pick = lambda rows, label: rows.select(F.lit(label).alias("label"), "fragment", F.col("paragraph_id").alias("id1"), "id2")
    return pick(pos, 1).unionByName(pick(neg, 0))


def pair_transition(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring paragraphs (1) and those four apart (0) within a fragment."""
    w = Window.partitionBy("fragment").orderBy("pf_id")
    p = base.placements(spark, sf)
    rows = p.select("fragment", "paragraph_id", F.lead("paragraph_id", 1).over(w).alias("next"), F.lead("paragraph_id", 4).over(w).alias("far"))
    pos = rows.where("next IS NOT NULL").select(F.lit(1).alias("label"), "fragment", F.col("paragraph_id").alias("id1"), F.col("next").alias("id2"))
    neg = rows.where("far IS NOT NULL").select(F.lit(0).alias("label"), "fragment", F.col("paragraph_id").alias("id1"), F.col("far").alias("id2"))
    return pos.unionByName(neg)


def sliding_window_k(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three paragraphs; shorter lists come out whole."""
    w = Window.partitionBy("fragment").orderBy("pf_id")
    all_ = Window.partitionBy("fragment")
    rows = base.placements(spark, sf).select("fragment", "pf_id", F.collect_list("paragraph_id").over(w.rowsBetween(0, 2)).alias("items"), F.row_number().over(w).alias("at"), F.count("*").over(all_).alias("n"))
    return rows.where((F.size("items") == 3) | ((F.col("n") < 3) & (F.col("at") == 1))).select("fragment", F.array_join("items", ",").alias("items"))


def running_count_topk(spark: SparkSession, sf: str) -> DataFrame:
    """At most two links to each target, in order of link id."""
    w = Window.partitionBy("dest").orderBy("link_id")
    return base.links(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 2").select("link_id", "dest", "k")


def svm_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Linear classifiers of run features over a grid of 20 costs on balanced classes, with their F1 on held-out queries; the best first."""
    rows, _ = _feature_rows(spark, sf)
    labelled = rows.join(base.qrels(spark, sf).select("query_id", "doc_id", (F.col("rel") > 0).cast("int").alias("label")), ["query_id", "doc_id"])
    rows = learning.standardised(learning.balanced(materialize(labelled, "labelled"), ["query_id", "doc_id"]))[0]
    grid = learning.svm_grid(rows.withColumn("held", F.pmod(F.xxhash64("query_id"), F.lit(4)) == 0))
    return spark.createDataFrame([(c, f1) for c, f1, _ in grid], "c double, f1 double")


def coordinate_ascent(spark: SparkSession, sf: str) -> DataFrame:
    """Feature weights of all methods that raise mean average precision, for each fold of queries."""
    rows, methods = _feature_rows(spark, sf)
    weights, trained, tested, spread = learning.coordinate_ascent(rows, _relevant(spark, sf))
    out = [(f, m, w, raw, trained[f], tested[f]) for f, ws in enumerate(weights) for m, w, raw in zip(methods, ws, learning.raw_weights(ws, spread))]
    return spark.createDataFrame(out, "fold int, feature string, weight double, raw_weight double, train_map double, test_map double")


def category_features(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as sets of their sections' headings, by number in a dictionary of the 500 commonest."""
    f = base.fragments(spark, sf).where("parent IS NOT NULL AND title IS NOT NULL").select(F.col("parent").alias("id"), F.trim("title").alias("category"))
    vectors, _ = learning.category_vectors(f, 500)
    return vectors.select("id", F.array_join("indices", ",").alias("indices"))


QUERIES = {
    f.__name__: f
    for f in (map_score, average_precisions, prf1_at_5, prf1_avg, mean_stderr_table, system_ranks, kendall_tau, spearman, cronbach_alpha, confusion_matrix, cohen_kappa, cohen_kappa_adjacent, fleiss_kappa, qrel_overlap, assessor_counts, seconds_per_assessment, new_assessments, qrel_binary, qrel_augment, qrel_drop_unjudged, qrel_pad_full, assess_merge_latest, assess_filter_time, assess_filter_run, assess_clean, assess_anonymize, assess_merge_annotators, assess_first_file_wins, assess_run_union, assessments_to_qrels, grade_remap, label_to_grade, missing_stats, page_metrics, repair_transitions, run_features_pivot, run_feature_summary, zscore_features, posify_weights, balanced_sample, pair_relevance, pair_cluster, pair_transition, sliding_window_k, running_count_topk, svm_grid, coordinate_ascent, category_features)
}

_RK = f"{base.QREL}, {base.RUN}, relv AS (SELECT query_id, doc_id FROM qrel WHERE rel > 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank FROM run WHERE query_id IN (SELECT query_id FROM relv)), nrel AS (SELECT query_id, count(*) AS n_rel FROM relv GROUP BY ALL), hits AS (SELECT r.*, (v.doc_id IS NOT NULL)::INT AS hit FROM ranked r LEFT JOIN relv v USING (query_id, doc_id))"
_AP = f"{_RK}, aps AS (SELECT query_id, method, sum(hit * cum / rank) / any_value(n_rel) AS ap FROM (SELECT *, sum(hit) OVER (PARTITION BY query_id, method ORDER BY rank) AS cum FROM hits) JOIN nrel USING (query_id) GROUP BY query_id, method)"
_PRF = f"{_RK}, c AS (SELECT query_id, method, count(*) AS n, sum(hit) AS tp FROM hits WHERE rank <= 5 GROUP BY ALL), prf AS (SELECT query_id, method, tp / n AS precision, tp / n_rel AS recall, CASE WHEN tp > 0 THEN 2 * (tp / n) * (tp / n_rel) / (tp / n + tp / n_rel) ELSE 0 END AS f1 FROM c JOIN nrel USING (query_id))"
_SYS = _AP + ", " + _PRF.split(", c AS (", 1)[1].join(["c AS (", ""]) + ", maps AS (SELECT method AS system, round(avg(ap), 9) AS a FROM aps GROUP BY ALL), pres AS (SELECT method AS system, round(avg(precision), 9) AS b FROM prf GROUP BY ALL), sys AS (SELECT system, row_number() OVER (ORDER BY a DESC, system) AS rank_a, row_number() OVER (ORDER BY b DESC, system) AS rank_b FROM maps JOIN pres USING (system))"
_LP = f"{base.JUDGE}, lp AS (SELECT x.query_id, x.doc_id, x.assessor AS a, y.assessor AS b, x.rel AS rel_a, y.rel AS rel_b FROM judge x JOIN judge y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.assessor < y.assessor)"
_MERGED = f"{_STATE}, merged AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paragraph_id, facet_id ORDER BY time_stamp DESC NULLS LAST, session_id DESC NULLS LAST, relevance DESC) AS rn FROM state WHERE relevance IS NOT NULL) WHERE rn = 1)"
_PAGE = f"{_MERGED}, page AS (SELECT query_id, paragraph_id, time_stamp, facet, relevance FROM (SELECT *, coalesce(facet_id, '') AS facet, row_number() OVER (PARTITION BY query_id, paragraph_id ORDER BY time_stamp DESC NULLS LAST, coalesce(facet_id, '') DESC, relevance DESC) AS rn FROM merged) WHERE rn = 1)"


def _kappa(keys: str, source: str, a: str, b: str) -> str:
    k, on = (keys + ", " if keys else ""), (f"USING ({keys})" if keys else "ON true")
    grp = f"GROUP BY {keys}" if keys else ""
    return f"""t AS (SELECT {k}count(*) AS n, sum(({a} = {b})::INT) AS same FROM {source} {grp}),
        m AS (SELECT {k}sum(x.c * y.c) AS m FROM (SELECT {k}{a} AS g, count(*) AS c FROM {source} GROUP BY ALL) x JOIN (SELECT {k}{b} AS g, count(*) AS c FROM {source} GROUP BY ALL) y USING ({k}g) {grp})
        SELECT {k}n, round(CASE WHEN coalesce(m, 0) / (n * n) < 1 THEN (same / n - coalesce(m, 0) / (n * n)) / (1 - coalesce(m, 0) / (n * n)) END, 9) AS kappa FROM t LEFT JOIN m {on}"""


SQL = {
    "map_score": f"WITH {_AP} SELECT method, count(*) AS n, round(avg(ap), 9) AS map FROM aps GROUP BY ALL",
    "average_precisions": f"WITH {_AP} SELECT query_id, method, round(ap, 9) AS ap FROM aps",
    "prf1_at_5": f"WITH {_PRF} SELECT query_id, method, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM prf",
    "prf1_avg": f"WITH {_PRF} SELECT method, round(avg(precision), 9) AS precision, round(avg(recall), 9) AS recall, round(avg(f1), 9) AS f1 FROM prf GROUP BY ALL",
    "mean_stderr_table": f"WITH {_AP} SELECT method, round(avg(ap), 9) AS mean, round(stddev_pop(ap) / sqrt(count(*)), 9) AS stderr FROM aps GROUP BY ALL",
    "system_ranks": f"WITH {_SYS} SELECT system, rank_a, rank_b FROM sys",
    "kendall_tau": f"WITH {_SYS} SELECT count(*) AS n_pairs, round((2 * sum((x.rank_b < y.rank_b)::INT) - count(*)) / count(*), 9) AS tau FROM sys x JOIN sys y ON x.rank_a < y.rank_a",
    "spearman": f"WITH {_SYS} SELECT count(*) AS n, round(1 - 6 * sum((rank_a - rank_b) ** 2) / (count(*) * (count(*) ** 2 - 1)), 9) AS rho FROM sys",
    "cronbach_alpha": f"""WITH {_AP}, sets AS (SELECT query_id, list_sort(list(method)) AS methods FROM aps GROUP BY query_id HAVING count(*) >= 3),
        common AS (SELECT methods FROM sets GROUP BY methods ORDER BY count(*) DESC, array_to_string(methods, ',') LIMIT 1), v AS (SELECT * FROM aps WHERE query_id IN (SELECT query_id FROM sets JOIN common USING (methods)))
        SELECT k, round(k / (k - 1) * (1 - items / total), 6) AS alpha FROM (SELECT count(DISTINCT query_id) AS k FROM v), (SELECT sum(x) AS items FROM (SELECT var_pop(ap) AS x FROM v GROUP BY query_id)), (SELECT var_pop(t) AS total FROM (SELECT sum(ap) AS t FROM v GROUP BY method))""",
    "confusion_matrix": f"WITH {_LP} SELECT rel_a, rel_b, count(*) AS n FROM lp GROUP BY ALL",
    "cohen_kappa": f"WITH {_LP}, {_kappa('a, b', 'lp', 'rel_a', 'rel_b')}",
    "cohen_kappa_adjacent": f"WITH {_LP}, cut AS (SELECT rel_a >= 1 AS rel_a, rel_b >= 1 AS rel_b FROM lp), {_kappa('', 'cut', 'rel_a', 'rel_b')}",
    "fleiss_kappa": f"""WITH {base.JUDGE}, f AS (SELECT query_id, doc_id FROM judge GROUP BY ALL HAVING count(*) = 3), c AS (SELECT query_id, doc_id, rel, count(*) AS c FROM judge JOIN f USING (query_id, doc_id) GROUP BY ALL),
        o AS (SELECT count(*) AS n_items, avg(p) AS p_bar FROM (SELECT (sum(c * c) - 3) / 6 AS p FROM c GROUP BY query_id, doc_id)), e AS (SELECT sum((t / (n_items * 3)) ** 2) AS pe FROM (SELECT rel, sum(c) AS t FROM c GROUP BY rel), o) SELECT n_items, round((p_bar - pe) / (1 - pe), 9) AS kappa FROM o, e""",
    "qrel_overlap": f"WITH {_LP} SELECT a, b, count(*) AS n_both, CAST(sum((rel_a = rel_b)::INT) AS BIGINT) AS n_same FROM lp GROUP BY ALL",
    "assessor_counts": f"WITH {base.JUDGE} SELECT assessor, count(*) AS n, CAST(sum((rel > 0)::INT) AS BIGINT) AS n_positive FROM judge GROUP BY ALL",
    "seconds_per_assessment": f"WITH {base.JUDGE} SELECT assessor, count(*) AS n, round((max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000)) / nullif(count(*) - 1, 0), 6) AS seconds FROM judge GROUP BY ALL",
    "new_assessments": f"WITH {base.JUDGE} SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n FROM (SELECT min(ts) AS ts FROM judge GROUP BY query_id, doc_id) GROUP BY ALL",
    "qrel_binary": f"WITH {base.QREL} SELECT query_id, doc_id, CASE WHEN rel < 2 THEN 0 ELSE 1 END AS rel FROM qrel",
    "qrel_augment": f"WITH {base.QREL}, {base.RUN} SELECT r.query_id, r.doc_id, coalesce(rel, 0) AS rel FROM run r LEFT JOIN qrel USING (query_id, doc_id) WHERE method = 'bm25'",
    "qrel_drop_unjudged": f"WITH {base.QREL}, {base.RUN} SELECT r.query_id, r.doc_id, score, rel FROM run r JOIN qrel USING (query_id, doc_id) WHERE method = 'bm25'",
    "qrel_pad_full": f"WITH {base.QREL}, {base.PLACE} SELECT coalesce(m.doc_id, a.doc_id) AS doc_id, coalesce(auto, 0) AS auto, manual FROM (SELECT doc_id, max(rel) AS manual FROM qrel GROUP BY ALL) m FULL JOIN (SELECT DISTINCT paragraph_id AS doc_id, 1 AS auto FROM place) a ON a.doc_id = m.doc_id",
    "assess_merge_latest": f"WITH {_MERGED} SELECT * FROM merged",
    "assess_filter_time": f"WITH {_STATE} SELECT * FROM state WHERE time_stamp > TIMESTAMP '2025-09-01 00:00:00'",
    "assess_filter_run": f"WITH {_STATE}, {_META} SELECT query_id, paragraph_id, session_id, relevance FROM state WHERE session_id IN (SELECT session_id FROM meta WHERE list_has_any(run_ids, ['run-ltr', 'run-cosine']))",
    "assess_clean": f"WITH {_STATE} SELECT query_id, paragraph_id, coalesce(facet_id, 'none') AS facet_id, session_id, coalesce(relevance, 2) AS relevance FROM state WHERE facet_id IS NOT NULL OR relevance IS NOT NULL",
    "assess_anonymize": f"WITH {_STATE} SELECT query_id, paragraph_id, facet_id, relevance, 'session' AS session_id, 'assessor' AS assessor FROM state",
    "assess_merge_annotators": f"WITH {base.JUDGE} SELECT query_id, doc_id, assessor, rel FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY assessor, ts DESC) AS rn2 FROM judge) WHERE rn2 = 1",
    "assess_first_file_wins": f"WITH {_STATE} SELECT query_id, paragraph_id, session_id, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paragraph_id ORDER BY session_id NULLS FIRST, coalesce(facet_id, ''), time_stamp NULLS FIRST, relevance) AS rn FROM state WHERE relevance IS NOT NULL) WHERE rn = 1",
    "assess_run_union": f"WITH {_STATE}, {_META} SELECT query_id, list_sort(list_distinct(list(r))) AS run_ids FROM (SELECT query_id, unnest(run_ids) AS r FROM (SELECT DISTINCT query_id, session_id FROM state) JOIN meta USING (session_id)) GROUP BY query_id",
    "assessments_to_qrels": f"WITH {_MERGED} SELECT query_id || '/' || facet_id AS query_id, paragraph_id AS doc_id, relevance AS rel, 'section' AS level FROM merged WHERE facet_id IS NOT NULL UNION ALL SELECT query_id, paragraph_id, max(relevance), 'page' FROM merged GROUP BY query_id, paragraph_id",
    "grade_remap": f"WITH {base.QREL} SELECT query_id, doc_id, CASE rel WHEN -2 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE rel END AS rel FROM qrel",
    "label_to_grade": f"WITH {_STATE} SELECT CASE relevance WHEN 3 THEN 'must' WHEN 2 THEN 'should' WHEN 1 THEN 'can' WHEN 0 THEN 'nonrel' WHEN -2 THEN 'trash' ELSE 'unset' END AS label, count(*) AS n, min(relevance) AS grade FROM state GROUP BY 1",
    "missing_stats": f"WITH {_STATE}, p AS (SELECT query_id, paragraph_id, count(relevance) AS s, count(facet_id) AS f FROM state GROUP BY ALL) SELECT query_id, count(*) AS n, count(*) FILTER (s = 0) AS n_unset, count(*) FILTER (f = 0) AS n_no_facet FROM p GROUP BY query_id",
    "page_metrics": f"WITH {_PAGE}, n AS (SELECT *, lag(facet) OVER (PARTITION BY query_id ORDER BY time_stamp NULLS FIRST, paragraph_id NULLS FIRST) AS previous FROM page) SELECT query_id, round(coalesce(avg(CASE WHEN previous IS NOT NULL THEN (previous = facet)::INT END), 0), 9) AS facet_overlap, round(avg(greatest(relevance, 0) / 3), 9) AS relevance FROM n GROUP BY query_id",
    "repair_transitions": f"WITH {_PAGE} SELECT query_id, previous AS paragraph_id1, paragraph_id AS paragraph_id2 FROM (SELECT *, lag(paragraph_id) OVER (PARTITION BY query_id ORDER BY time_stamp NULLS FIRST, paragraph_id NULLS FIRST) AS previous FROM page WHERE relevance >= 0) WHERE previous IS NOT NULL",
}
_RALL = f"{base.RUN}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, method ORDER BY score DESC, doc_id) AS rank FROM run)"
SQL |= {
    "run_features_pivot": f"WITH {_RALL}, items AS (SELECT DISTINCT query_id, doc_id, m.method FROM ranked r JOIN ranking_methods x ON x.method = r.method, ranking_methods m) SELECT query_id, doc_id, method, round(coalesce(1.0::DOUBLE / rank, 0), 9) AS reciprocal FROM items LEFT JOIN ranked USING (query_id, doc_id, method)",
    "category_features": f"WITH {base.FRAG}, c AS (SELECT DISTINCT parent AS id, trim(title, ' ') AS category FROM frag WHERE parent IS NOT NULL AND title IS NOT NULL), d AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS i FROM c GROUP BY category) SELECT id, array_to_string(list(i ORDER BY i), ',') AS indices FROM c JOIN d USING (category) WHERE i < 500 GROUP BY id",
    "run_feature_summary": f"WITH {_RALL} SELECT query_id, doc_id, count(*) AS n_runs, round(sum(1.0::DOUBLE / rank), 9) AS sum_rr, min(rank) AS best_rank FROM ranked GROUP BY ALL",
    "zscore_features": f"WITH {base.RUN}, s AS (SELECT method, avg(score) AS m, stddev_pop(score) AS s FROM run GROUP BY ALL) SELECT query_id, doc_id, method, round((score - m) / s, 6) AS z FROM run JOIN s USING (method)",
    "posify_weights": f"WITH {base.RUN}, r AS (SELECT *, min(score) OVER w AS low, stddev_pop(score) OVER w AS s FROM run WHERE method = 'ltr' WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(exp(score), 6) AS exponential, round(exp(coalesce(score / nullif(s, 0), 0)), 6) AS denormal, round(1 / (1 + exp(-score)), 6) AS logistic, round(greatest(score, 0.0), 6) AS cut, round(score - low + 1.0, 6) AS linear FROM r",
    "balanced_sample": f"WITH {base.QREL}, q AS (SELECT query_id, doc_id, (rel > 0)::INT AS label, md5(concat_ws('|', query_id, doc_id)) AS h FROM qrel), l AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM q GROUP BY label)) SELECT query_id, doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS k FROM q), l WHERE k <= least",
    "pair_relevance": f"WITH {base.FRAG}, {base.PLACE} SELECT 1 AS label, fragment, paragraph_id, title FROM place JOIN frag ON id = fragment WHERE title IS NOT NULL",
    "pair_cluster": f"WITH {base.PLACE}, {base.FRAG}, p AS (SELECT place.*, page_id FROM place JOIN frag ON id = fragment WHERE page_id IS NOT NULL), f AS (SELECT page_id, fragment, arg_min(paragraph_id, pf_id) AS first FROM p GROUP BY ALL), n AS (SELECT fragment, lead(first) OVER (PARTITION BY page_id ORDER BY fragment) AS id2 FROM f) SELECT 1 AS label, fragment, paragraph_id AS id1, id2 FROM (SELECT *, lead(paragraph_id, 2) OVER (PARTITION BY fragment ORDER BY pf_id) AS id2 FROM p) WHERE id2 IS NOT NULL UNION ALL SELECT 0, fragment, paragraph_id, id2 FROM p JOIN n USING (fragment) WHERE id2 IS NOT NULL",
    "pair_transition": f"WITH {base.PLACE}, r AS (SELECT fragment, paragraph_id, lead(paragraph_id, 1) OVER w AS n1, lead(paragraph_id, 4) OVER w AS n4 FROM place WINDOW w AS (PARTITION BY fragment ORDER BY pf_id)) SELECT 1 AS label, fragment, paragraph_id AS id1, n1 AS id2 FROM r WHERE n1 IS NOT NULL UNION ALL SELECT 0, fragment, paragraph_id, n4 FROM r WHERE n4 IS NOT NULL",
    "sliding_window_k": f"WITH {base.PLACE}, r AS (SELECT fragment, row_number() OVER w AS pos, count(*) OVER (PARTITION BY fragment) AS n, list(paragraph_id) OVER (PARTITION BY fragment ORDER BY pf_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS items FROM place WINDOW w AS (PARTITION BY fragment ORDER BY pf_id)) SELECT fragment, array_to_string(items, ',') AS items FROM r WHERE len(items) = 3 OR (n < 3 AND pos = 1)",
    "running_count_topk": f"WITH {base.LINK} SELECT link_id, dest, k FROM (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY link_id) AS k FROM link) WHERE k <= 2",
}
