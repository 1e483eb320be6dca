"""Scalar functions, set operations, windows over events and the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import stable_bucket
from ..operators import ranking
from . import base
from .tables import table


def entity_passage_split(spark: SparkSession, sf: str) -> DataFrame:
    """Run ids of the form passage/entity taken apart again."""
    l = base.links(spark, sf).where("paragraph IS NOT NULL").select("link_id", F.concat_ws("/", "paragraph", F.col("dest").cast("string")).alias("v"))  # noqa: E741
    p, e = text.passage_and_entity(F.col("v"))
    return l.select("link_id", p.alias("passage"), e.alias("entity"))


def legal_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Page ids rebuilt from decoded titles."""
    f = base.fragments(spark, sf).where("parent IS NULL AND page_id IS NOT NULL").select("page_id").distinct()
    title = text.title_of_id(F.col("page_id"))
    return f.select("page_id", title.alias("title"), F.concat(F.lit("wkx:"), text.escape_id(title)).alias("escaped"))


def url_codec(spark: SparkSession, sf: str) -> DataFrame:
    t = base.fragments(spark, sf).where("title IS NOT NULL").select("id", "title")
    return t.select("id", (text.unescape_id(text.escape_id(F.col("title"))) == F.col("title")).alias("same"))


def page_name_norm(spark: SparkSession, sf: str) -> DataFrame:
    return base.links(spark, sf).where("anchor IS NOT NULL AND anchor <> ''").select("link_id", text.page_name(F.col("anchor")).alias("name"))


def entity_name_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Names taken out of external addresses; others give null."""
    v = F.when(F.col("link_id") % 3 == 0, F.concat(F.lit("<dbpedia:"), "anchor", F.lit("_x>"))).when(F.col("link_id") % 3 == 1, F.concat(F.lit("https://en.wikipedia.org/wiki/"), "anchor")).otherwise(F.col("anchor"))
    return base.links(spark, sf).where("anchor IS NOT NULL").select("link_id", text.entity_name(v).alias("name"))


def item_id_parse(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.when(F.col("link_id") % 2 == 0, F.lit("Q")).otherwise(F.lit("P")), F.col("link_id").cast("string"), F.lit("#x"))
    return base.links(spark, sf).select("link_id", text.item_number(v).alias("item"))


def category_rename(spark: SparkSession, sf: str) -> DataFrame:
    f = base.fragments(spark, sf).where("title IS NOT NULL")
    return f.select("id", text.category_key(F.concat(F.lit("Category:"), "title")).alias("key"))


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return base.paragraphs(spark, sf).where("content IS NOT NULL").select("id", text.content_id(F.col("content")).alias("hash"), stable_bucket(F.col("id"), 16, "s").alias("bucket"))


def wrapped_lines(spark: SparkSession, sf: str) -> DataFrame:
    return base.paragraphs(spark, sf).where("content IS NOT NULL").select("id", F.length(text.wrap_lines(F.regexp_replace("content", r"\s+", " "), 80)).alias("n"))


def latex_escape(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.escape_latex(F.col("text"))).alias("h"))


def entity_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Character references resolved by a vectorised function."""
    v = F.concat(F.lit("&lt;"), "anchor", F.lit("&gt; &amp; &#65;&#x42; &unknown;"))
    return base.links(spark, sf).where("anchor IS NOT NULL").select("link_id", text.entity_decoder()(v).alias("decoded"))


def path_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """All prefixes of a query's path, and the parent of the whole path."""
    q = table(spark, sf, "assessments").select("query_id").where("query_id IS NOT NULL").distinct().withColumn("p", F.split("query_id", "/"))
    return q.select("query_id", F.explode(text.path_prefixes(F.col("p"))).alias("prefix"), text.path_text(text.parent_path(F.col("p"))).alias("parent")).select("query_id", F.array_join("prefix", "/").alias("prefix"), "parent")


def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Typed reading of a JSON column; rows that do not parse give null."""
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def json_permissive(spark: SparkSession, sf: str) -> DataFrame:
    """Rows or errors: every third record is cut short and comes out as corrupt."""
    raw = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("raw"))
    parsed = raw.withColumn("j", F.from_json("raw", "k int, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}))
    return parsed.select("event_id", F.col("j.k").alias("k"), F.col("j._corrupt_record").isNotNull().alias("corrupt"))


def json_union_decode(spark: SparkSession, sf: str) -> DataFrame:
    """A field that is a number in some records and an object in others."""
    raw = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"v":'), "props", F.lit("}"))).otherwise(F.concat(F.lit('{"v":'), F.col("event_id").cast("string"), F.lit("}"))).alias("raw"))
    v = F.try_parse_json("raw")
    return raw.select("event_id", F.coalesce(F.try_variant_get(v, "$.v.k", "bigint"), F.try_variant_get(v, "$.v", "bigint")).alias("v"))


def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_type", F.col("user_id"))).alias("j"))


# -- set operations -----------------------------------------------------------------------------------


def _two(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    r = base.runs(spark, sf)
    return r.where("method = 'bm25'").select("query_id", "doc_id"), r.where("method = 'ql'").select("query_id", "doc_id")


_TWO = f"{base.RUN}, a AS (SELECT query_id, doc_id FROM run WHERE method = 'bm25'), b AS (SELECT query_id, doc_id FROM run WHERE method = 'ql')"


def set_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return a.union(b).distinct()


def set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return a.intersect(b)


def set_except(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf)
    return a.subtract(b)


def set_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Whether both runs answer the same queries, with the number of differences."""
    a, b = (x.select("query_id").distinct() for x in _two(spark, sf))
    n = a.subtract(b).union(b.subtract(a)).agg(F.count("*").alias("n_different"))
    return n.select("n_different", (F.col("n_different") == 0).alias("equal"))


def union_combine(spark: SparkSession, sf: str) -> DataFrame:
    """Maps united with a combining sum."""
    r = base.runs(spark, sf)
    a = r.where("method = 'bm25'").groupBy("query_id").agg(F.count("*").alias("n"))
    b = r.where("method = 'ql'").groupBy("query_id").agg(F.count("*").alias("n"))
    return a.unionByName(b).groupBy("query_id").agg(F.sum("n").alias("n"))


def left_biased_union(spark: SparkSession, sf: str) -> DataFrame:
    r = base.runs(spark, sf).where("method IN ('bm25', 'ql')")
    first = F.when(F.col("method") == "bm25", 0).otherwise(1)
    return r.groupBy("query_id", "doc_id").agg(F.min(F.struct(first.alias("side"), "score")).alias("m")).select("query_id", "doc_id", "m.side", "m.score")


def unordered_edges(spark: SparkSession, sf: str) -> DataFrame:
    l = base.links(spark, sf)  # noqa: E741
    return l.select(F.least("src", "dest").alias("a"), F.greatest("src", "dest").alias("b")).distinct()


def disjoint_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a query that share no facet with the session before them."""
    q = table(spark, sf, "assessments").where("facet_id IS NOT NULL AND query_id IS NOT NULL").groupBy("query_id", "session_id").agg(F.collect_set("facet_id").alias("f"))
    w = Window.partitionBy("query_id").orderBy("session_id")
    n = q.select("query_id", F.lag("session_id").over(w).alias("a"), F.col("session_id").alias("b"), F.lag("f").over(w).alias("fa"), "f")
    return n.where("a IS NOT NULL").where(~F.arrays_overlap("fa", "f")).select("query_id", "a", "b")


def subgraph_restrict(spark: SparkSession, sf: str) -> DataFrame:
    """Links with both ends among the living fragments."""
    alive = base.fragments(spark, sf).where("NOT deleted").select("id")
    l = base.links(spark, sf).select("link_id", "src", "dest")  # noqa: E741
    return l.join(alive.withColumnRenamed("id", "src"), "src", "left_semi").join(alive.withColumnRenamed("id", "dest"), "dest", "left_semi").select("link_id", "src", "dest")


# -- events and the star schema -----------------------------------------------------------------------------


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return e.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of each user: gaps of more than 30 minutes part them."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w)) > 1_800_000_000).alias("gap"))
    s = e.withColumn("session", F.sum(F.coalesce(F.col("gap").cast("int"), F.lit(0))).over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"))


def event_latest_state(spark: SparkSession, sf: str) -> DataFrame:
    """The latest event of every user and type."""
    return table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m")).select("user_id", "event_type", "m.event_id", "m.value")


def chunk_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 100 events each per type, in order of id."""
    k = ranking.list_ranks(table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], [F.asc("event_id")], "k")
    return k.select("event_id", "event_type", F.floor((F.col("k") - 1) / 100).cast("int").alias("chunk"))


def systematic_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Every 50th event of a type, beginning with the first."""
    return ranking.list_ranks(table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], [F.asc("event_id")], "k").where("k % 50 = 1")


def target_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Link targets with at least five links, most linked first."""
    return base.links(spark, sf).groupBy("dest").agg(F.count("*").alias("n")).where("n >= 5")


def candidate_check(spark: SparkSession, sf: str) -> DataFrame:
    """Links by how many placings of their paragraph fit their source: none, one or several."""
    l = base.links(spark, sf).where("paragraph IS NOT NULL").select("link_id", "src", F.col("paragraph").alias("paragraph_id"))  # noqa: E741
    p = base.placements(spark, sf).withColumnRenamed("fragment", "src")
    n = l.join(p, ["paragraph_id", "src"], "left").groupBy("link_id").agg(F.count("pf_id").alias("n"))
    return n.select("link_id", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("several").alias("fit"))


def span_split(spark: SparkSession, sf: str) -> DataFrame:
    """The paragraph around the first occurrence of each anchor: text before and after it."""
    l = base.links(spark, sf).where("paragraph IS NOT NULL AND anchor IS NOT NULL AND anchor <> ''").select("link_id", "anchor", F.col("paragraph").alias("id"))  # noqa: E741
    j = l.join(base.paragraphs(spark, sf), "id").withColumn("at", F.expr("instr(content, anchor)")).where("at > 0")
    return j.select("link_id", (F.col("at") - 1).alias("start"), (F.col("at") - 1 + F.length("anchor")).alias("stop"), F.expr("length(content) - (at - 1 + length(anchor))").alias("rest"))


def span_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Anchors and the stretches of 100 characters (reaching 20 beyond) of their paragraph that they overlap.

    A span meets the stretches whose numbers follow from its ends, so the join is one of equal keys.
    """
    s = span_split(spark, sf).join(base.links(spark, sf).select("link_id", "paragraph"), "link_id")
    first, last = F.greatest(F.floor((F.col("start") - 20) / 100) + 0, F.lit(0)), F.floor((F.col("stop") - 1) / 100)
    met = s.select("link_id", "paragraph", "start", "stop", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("stretch"))
    chunks = base.paragraphs(spark, sf).where("content <> ''").select(F.col("id").alias("paragraph"), F.explode(F.sequence(F.lit(0), F.floor((F.length("content") - 1) / 100).cast("int"))).alias("stretch"))
    return met.join(chunks, ["paragraph", "stretch"]).where("start < stretch * 100 + 120 AND stop > stretch * 100").select("link_id", "stretch")


def star_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue per region and nation, with subtotals."""
    l = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("rev"))  # noqa: E741
    s = l.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.sum("rev").cast("double").alias("revenue"))


def star_pricing(spark: SparkSession, sf: str) -> DataFrame:
    """Sums per return flag and line status up to a ship date."""
    l = table(spark, sf, "lineitem").where("l_shipdate <= timestamp'1998-09-02 00:00:00'")  # noqa: E741
    d = lambda c: c.cast("decimal(18,4)")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.sum(d(F.col("l_quantity"))).cast("double").alias("sum_qty"), F.sum(d(F.col("l_extendedprice"))).cast("double").alias("sum_price"), F.count("*").alias("n"))


def star_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without an urgent order, per market segment."""
    c = table(spark, sf, "customer").join(table(spark, sf, "orders").where("o_orderpriority LIKE '1%'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (entity_passage_split, legal_ids, url_codec, page_name_norm, entity_name_parse, item_id_parse, category_rename, content_hash, wrapped_lines, latex_escape, entity_decode, path_prefixes, json_props, json_permissive, json_union_decode, json_round_trip, set_union, set_intersect, set_except, set_equality, union_combine, left_biased_union, unordered_edges, disjoint_facets, subgraph_restrict, event_windows, event_sessions, event_latest_state, chunk_numbering, systematic_sample, target_histogram, candidate_check, span_split, span_overlap_join, star_rollup, star_pricing, star_customers)
}

_SPANS = f"{base.LINK}, {base.PARA}, spans AS (SELECT link_id, paragraph, instr(content, anchor) - 1 AS start, instr(content, anchor) - 1 + length(anchor) AS stop, length(content) AS n FROM link JOIN para ON id = paragraph WHERE anchor <> '' AND instr(content, anchor) > 0)"

SQL = {
    "entity_passage_split": f"WITH {base.LINK}, v AS (SELECT link_id, paragraph || '/' || dest AS v FROM link WHERE paragraph IS NOT NULL) SELECT link_id, CASE WHEN regexp_matches(v, '^[0-9a-f]+/') THEN regexp_extract(v, '^([0-9a-f]+)/(.*)$', 1) ELSE '' END AS passage, CASE WHEN regexp_matches(v, '^[0-9a-f]+/') THEN regexp_extract(v, '^([0-9a-f]+)/(.*)$', 2) ELSE v END AS entity FROM v",
    "legal_ids": f"WITH {base.FRAG}, t AS (SELECT DISTINCT page_id, url_decode(regexp_replace(page_id, '^[^:]*:', '')) AS title FROM frag WHERE parent IS NULL AND page_id IS NOT NULL) SELECT page_id, title, 'wkx:' || replace(replace(url_encode(title), '~', '%7E'), '*', '*') AS escaped FROM t",
    "url_codec": f"WITH {base.FRAG} SELECT id, url_decode(url_encode(title)) = title AS same FROM frag WHERE title IS NOT NULL",
    "page_name_norm": f"WITH {base.LINK} SELECT link_id, upper(anchor[1]) || substr(anchor, 2) AS name FROM link WHERE anchor <> ''",
    "entity_name_parse": f"WITH {base.LINK}, v AS (SELECT link_id, CASE link_id % 3 WHEN 0 THEN '<dbpedia:' || anchor || '_x>' WHEN 1 THEN 'https://en.wikipedia.org/wiki/' || anchor ELSE anchor END AS v FROM link WHERE anchor IS NOT NULL), e AS (SELECT link_id, regexp_extract(v, '^(?:<dbpedia:|https?://[a-z]+\\.wikipedia\\.org/wiki/)([^>]+)>?$', 1) AS e FROM v) SELECT link_id, CASE WHEN e <> '' THEN replace(e, '_', ' ') END AS name FROM e",
    "item_id_parse": f"WITH {base.LINK} SELECT link_id, TRY_CAST(regexp_extract(CASE WHEN link_id % 2 = 0 THEN 'Q' ELSE 'P' END || link_id || '#x', '^Q([0-9]+)', 1) AS BIGINT) AS item FROM link",
    "category_rename": f"WITH {base.FRAG} SELECT id, replace(title, ' ', '_') AS key FROM frag WHERE title IS NOT NULL",
    "content_hash": f"WITH {base.PARA} SELECT id, sha1(content) AS hash, ('0x' || substr(md5('s' || id), 1, 8))::BIGINT % 16 AS bucket FROM para WHERE content IS NOT NULL",
    "wrapped_lines": f"WITH {base.PARA}, t AS (SELECT id, regexp_replace(content, '\\s+', ' ', 'g') AS t FROM para WHERE content IS NOT NULL) SELECT id, CAST(length(t) + length(t) // 80 AS INTEGER) AS n FROM t",
    "latex_escape": "SELECT doc_id, md5(regexp_replace(replace(text, '\\', '\\textbackslash '), '([#$%&_{}])', '\\\\\\1', 'g')) AS h FROM documents WHERE text IS NOT NULL",
    "path_prefixes": "WITH q AS (SELECT DISTINCT query_id, string_split(query_id, '/') AS p FROM assessments WHERE query_id IS NOT NULL) SELECT query_id, array_to_string(p[:i], '/') AS prefix, CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], '/') END AS parent FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM q)",
    "json_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events",
    "json_permissive": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k, event_id % 3 = 0 AS corrupt FROM events",
    "json_union_decode": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) ELSE event_id END AS v FROM events",
    "json_round_trip": "SELECT event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' AS j FROM events",
    "set_union": f"WITH {_TWO} SELECT * FROM a UNION SELECT * FROM b",
    "set_intersect": f"WITH {_TWO} SELECT * FROM a INTERSECT SELECT * FROM b",
    "set_except": f"WITH {_TWO} SELECT * FROM a EXCEPT SELECT * FROM b",
    "set_equality": f"WITH {_TWO}, x AS (SELECT query_id FROM a), y AS (SELECT query_id FROM b), d AS ((SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL (SELECT * FROM y EXCEPT SELECT * FROM x)) SELECT count(*) AS n_different, count(*) = 0 AS equal FROM d",
    "union_combine": f"WITH {_TWO} SELECT query_id, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL",
    "left_biased_union": f"WITH {base.RUN} SELECT query_id, doc_id, side, score FROM (SELECT query_id, doc_id, CASE WHEN method = 'bm25' THEN 0 ELSE 1 END AS side, score, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY method) AS rn FROM run WHERE method IN ('bm25', 'ql')) WHERE rn = 1",
    "unordered_edges": f"WITH {base.LINK} SELECT DISTINCT least(src, dest) AS a, greatest(src, dest) AS b FROM link",
    "disjoint_facets": "WITH q AS (SELECT query_id, session_id, list(DISTINCT facet_id) AS f FROM assessments WHERE facet_id IS NOT NULL AND query_id IS NOT NULL GROUP BY ALL), n AS (SELECT query_id, lag(session_id) OVER w AS a, session_id AS b, lag(f) OVER w AS fa, f FROM q WINDOW w AS (PARTITION BY query_id ORDER BY session_id NULLS FIRST)) SELECT query_id, a, b FROM n WHERE a IS NOT NULL AND NOT list_has_any(fa, f)",
    "subgraph_restrict": f"WITH {base.LINK}, {base.FRAG} SELECT link_id, src, dest FROM link WHERE src IN (SELECT id FROM frag WHERE NOT deleted) AND dest IN (SELECT id FROM frag WHERE NOT deleted)",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "event_sessions": "WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(coalesce(gap::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(ts) AS start FROM s GROUP BY user_id, session",
    "event_latest_state": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "chunk_numbering": "SELECT event_id, event_type, CAST((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 100 AS INTEGER) AS chunk FROM events",
    "systematic_sample": "SELECT * FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k % 50 = 1",
    "target_histogram": f"WITH {base.LINK} SELECT dest, count(*) AS n FROM link GROUP BY dest HAVING count(*) >= 5",
    "candidate_check": f"WITH {base.LINK}, {base.PLACE}, n AS (SELECT link_id, count(pf_id) AS n FROM link LEFT JOIN place ON paragraph_id = paragraph AND fragment = src WHERE paragraph IS NOT NULL GROUP BY link_id) SELECT link_id, CASE n WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'several' END AS fit FROM n",
    "span_split": f"WITH {_SPANS} SELECT link_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, CAST(n - stop AS INTEGER) AS rest FROM spans",
    "span_overlap_join": f"WITH {_SPANS}, c AS (SELECT id, CAST(unnest(range(0, length(content), 100)) // 100 AS INTEGER) AS stretch FROM para WHERE content <> '') SELECT link_id, stretch FROM spans JOIN c ON c.id = paragraph WHERE start < stretch * 100 + 120 AND stop > stretch * 100",
    "star_rollup": "SELECT r_name, n_name, CAST(sum(rev) AS DOUBLE) AS revenue FROM (SELECT l_suppkey, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS rev FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "star_pricing": "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "star_customers": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority LIKE '1%') GROUP BY ALL",
}
