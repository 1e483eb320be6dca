"""Readers of the formats the engine takes in; every reader returns a DataFrame."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prefixes of the namespaces whose pages are no articles.
OTHER_NAMESPACES = ["Media", "Special", "Talk", "User", "User talk", "Project", "Project talk", "File", "File talk", "MediaWiki", "MediaWiki talk", "Template", "Template talk", "Help", "Help talk", "Category talk", "Portal", "Draft", "Module"]


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"), F.input_file_name().alias("file"))


def _checked(rows: DataFrame, n: int, what: str) -> Column:
    return F.when(F.size("f") == n, F.col("f")).otherwise(F.raise_error(F.concat(F.lit(f"not a {what} line: "), F.array_join("f", " "))))


def run_file(spark: SparkSession, path: str) -> DataFrame:
    """``query Q0 doc rank score method`` lines."""
    rows = _fields(spark, path)
    f = rows.select(_checked(rows, 6, "run").alias("f"))
    return f.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("rank"), F.col("f")[4].cast("double").alias("score"), F.col("f")[5].alias("method"))


def qrel_file(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """``query iter doc grade`` lines; ``binary`` keeps only whether the grade is positive."""
    rows = _fields(spark, path)
    f = rows.select(_checked(rows, 4, "judgement").alias("f"), "file")
    rel = F.col("f")[3].cast("int")
    return f.select(F.col("f")[0].alias("query_id"), F.col("f")[2].alias("doc_id"), (F.when(rel > 0, 1).otherwise(0) if binary else rel).alias("rel"), "file")


def assessor_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgement files named ``user-session-yyyy-MM-dd-HHmm.ext``."""
    name = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    q = qrel_file(spark, path).withColumn("name", name)
    part = r"^([^-]+)-(.+)-(\d{4}-\d{2}-\d{2}-\d{4})$"
    return q.select("query_id", "doc_id", "rel", F.regexp_extract("name", part, 1).alias("assessor"), F.regexp_extract("name", part, 2).alias("session"), F.to_timestamp(F.regexp_extract("name", part, 3), "yyyy-MM-dd-HHmm").alias("ts"))


def duplicate_table(spark: SparkSession, path: str) -> DataFrame:
    """Lines of two ids; blank lines are skipped, other lines are errors."""
    rows = _fields(spark, path)
    f = rows.select(_checked(rows, 2, "duplicate").alias("f"))
    return f.select(F.col("f")[0].alias("a"), F.col("f")[1].alias("b"))


def eval_lines(spark: SparkSession, path: str) -> DataFrame:
    """``metric query value`` lines with the file; the value also as a number where it is one."""
    rows = _fields(spark, path)
    f = rows.select(_checked(rows, 3, "evaluation").alias("f"), "file")
    return f.select("file", F.col("f")[0].alias("metric"), F.col("f")[1].alias("query"), F.col("f")[2].alias("value"), F.col("f")[2].try_cast("double").alias("score"))


def eval_file(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """One row a file: its run id and the asked metrics over all queries."""
    rows = eval_lines(spark, path).where("query = 'all'")
    return rows.groupBy("file").agg(F.max(F.when(F.col("metric") == "runid", F.col("value"))).alias("run"), *[F.max(F.when(F.col("metric") == m, F.col("score"))).alias(m) for m in metrics])


def eval_per_query(spark: SparkSession, path: str, metric: str) -> DataFrame:
    return eval_lines(spark, path).where((F.col("metric") == metric) & (F.col("query") != "all") & F.col("score").isNotNull()).select("file", "query", "score")


def eval_named_files(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation files named ``run.assessment.type[.gz]``; compression is transparent."""
    name = F.split(F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.gz$", ""), r"\.")
    return eval_lines(spark, path).withColumn("n", name).select(F.col("n")[0].alias("run"), F.col("n")[1].alias("assessment"), F.col("n")[2].alias("kind"), "metric", "query", "score")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole-file JSON; a broken file fails."""
    r = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (r.schema(schema) if schema else r).json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_or_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Broken lines come out with the line in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def language_index(spark: SparkSession, path: str) -> DataFrame:
    """(item_id, site_id, page_name) of a JSON array of items with site links."""
    schema = "id string, sitelinks map<string, struct<site: string, title: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).where("sitelinks IS NOT NULL AND size(sitelinks) > 0")
    return rows.select(F.regexp_extract("id", "^Q([0-9]+)", 1).try_cast("bigint").alias("item_id"), F.explode("sitelinks").alias("site_id", "l")).select("item_id", "site_id", F.col("l.title").alias("page_name"))


def name_translation(index: DataFrame, source: str, target: str) -> DataFrame:
    """(name, translated): pages of one site under the name of another."""
    a = index.where(F.col("site_id") == source).select("item_id", F.col("page_name").alias("name"))
    return a.join(index.where(F.col("site_id") == target).select("item_id", F.col("page_name").alias("translated")), "item_id").select("name", "translated")


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With header; short lines are filled with nulls, blank lines skipped."""
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)


def topic_lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(F.regexp_extract("value", r"^(\S+)\s*(.*)$", 1).alias("id"), F.regexp_extract("value", r"^(\S+)\s*(.*)$", 2).alias("text"))


def xml_topics(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def other_namespaces(spark: SparkSession, path: str) -> list[str]:
    """Names of a dump's namespaces other than articles (0) and categories (14); one row a namespace."""
    names = spark.read.format("xml").option("rowTag", "namespace").schema("_key int, _VALUE string").load(path)
    return [r["_VALUE"] for r in names.where("_VALUE IS NOT NULL AND _key NOT IN (0, 14)").collect()]


def wiki_dump(spark: SparkSession, path: str, namespaces: list[str] | None = None) -> DataFrame:
    """title, ns, text of the pages of an XML dump, pages of other namespaces left out before parsing."""
    pages = spark.read.format("xml").option("rowTag", "page").schema("title string, ns int, id bigint, revision struct<text: string>").load(path)
    return interesting(pages.select("title", "ns", "id", F.col("revision.text").alias("text")), namespaces)


def interesting(pages: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    prefix = F.substring_index("title", ":", 1)
    return pages.where(~(F.col("title").contains(":") & prefix.isin(OTHER_NAMESPACES if namespaces is None else namespaces)))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files; the id is the base name without extension."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("id"), F.col("value").alias("text"))


def span_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``Tn<TAB>Class s e[;s e]<TAB>text`` lines; from the first fragment's start to the last one's end."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("file")).where("value LIKE 'T%'")
    mid = F.split("value", "\t")[1]
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(mid, r"^\S+", ""), F.lit(r"(\d+)")), lambda x: x.cast("int"))
    return rows.select("file", F.split("value", "\t")[0].alias("id"), F.regexp_extract(mid, r"^(\S+)", 1).alias("kind"), F.array_min(numbers).alias("start"), F.array_max(numbers).alias("stop"), F.split("value", "\t")[2].alias("text"))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(f[0].alias("word"), F.transform(F.slice(f, 2, F.size(f) - 1), lambda x: x.cast("float")).alias("vector"))


def synsets(spark: SparkSession, path: str) -> DataFrame:
    """Data files of a lexical database: offset, part of speech, words; licence lines begin with blanks."""
    f = F.split("value", " ")
    n = F.conv(f[3], 16, 10).cast("int")
    rows = spark.read.text(path).where("NOT startswith(value, ' ') AND value <> ''")
    return rows.select(f[0].cast("int").alias("offset"), f[2].alias("pos"), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(f, (5 + 2 * i).cast("int"))).alias("words"))


def confirmation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Run descriptions: header, paragraph, strong or blank, told by the tabs in front."""
    v = F.col("value")
    kind = F.when(F.trim(v) == "", "blank").when(v.startswith("Run "), "header").when(v.rlike("^\t\t"), "para").when(v.rlike("^\t"), "strong").otherwise("para")
    return spark.read.text(path).select(kind.alias("kind"), F.trim(F.regexp_replace(v, "^\t+", "")).alias("text"))


def simple_yaml(path: str) -> dict[str, Any]:
    """Flat keys with text or list values, as the import configuration uses."""
    out: dict[str, Any] = {}
    key = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            bare = line.rstrip("\n")
            if not bare.strip() or bare.lstrip().startswith("#"):
                continue
            if bare.lstrip().startswith("- ") and key is not None:
                if not isinstance(out[key], list):
                    out[key] = []
                out[key].append(bare.lstrip()[2:].strip().strip("'\""))
            else:
                key, _, value = bare.partition(":")
                key = key.strip()
                out[key] = value.strip().strip("'\"")
    return out


def postings_of(index: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the given terms; the filter reaches the scan."""
    return index.where(F.col("term").isin(terms))


# -- CBOR lists -----------------------------------------------------------------------------------


def decode_cbor(data: bytes, at: int = 0) -> tuple[Any, int]:
    """(value, position behind it) of one CBOR item (RFC 8949)."""
    head = data[at]
    kind, info = head >> 5, head & 31
    at += 1
    if info < 24:
        n: int | None = info
    elif info in (24, 25, 26, 27):
        size = 1 << (info - 24)
        n = int.from_bytes(data[at : at + size], "big")
        if kind == 7 and info > 24:
            return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[info], data[at : at + size])[0], at + size
        at += size
    elif info == 31:
        n = None
    else:
        raise ValueError("reserved CBOR length")
    if kind == 0:
        return n, at
    if kind == 1:
        return -1 - n, at
    if kind in (2, 3):
        if n is None:
            parts = []
            while data[at] != 0xFF:
                part, at = decode_cbor(data, at)
                parts.append(part)
            return (b"" if kind == 2 else "").join(parts), at + 1
        raw = data[at : at + n]
        return (raw if kind == 2 else raw.decode()), at + n
    if kind == 4:
        items = []
        while (n is None and data[at] != 0xFF) or (n is not None and len(items) < n):
            item, at = decode_cbor(data, at)
            items.append(item)
        return items, at + (n is None)
    if kind == 5:
        pairs: dict = {}
        k = 0
        while (n is None and data[at] != 0xFF) or (n is not None and k < n):
            key, at = decode_cbor(data, at)
            pairs[key], at = decode_cbor(data, at)
            k += 1
        return pairs, at + (n is None)
    if kind == 6:
        return decode_cbor(data, at)
    return {20: False, 21: True, 22: None, 23: None}.get(n, n), at


def cbor_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, value as JSON) of files that hold a header and an indefinite list; pos -1 is the header."""

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        plain = lambda x: x.hex() if isinstance(x, bytes) else str(x)
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"]):
                header, at = decode_cbor(data)
                rows = [(name, -1, json.dumps(header, default=plain, ensure_ascii=False))]
                at += data[at] == 0x9F
                pos = 0
                while at < len(data) and data[at] != 0xFF:
                    value, at = decode_cbor(data, at)
                    rows.append((name, pos, json.dumps(value, default=plain, ensure_ascii=False)))
                    pos += 1
                yield pd.DataFrame(rows, columns=["file", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(work, "file string, pos bigint, value string")


def entity_links(texts: DataFrame, client, schema: str = "id string, spot string, start int, stop int, title string, error string") -> DataFrame:
    """Annotations of an entity-linking service.

    ``client(text)`` returns rows (spot, start, stop, title); it is called in the workers, rows
    without title are dropped, and a failing document gives one row with its error. No client is shipped.
    """

    def work(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for key, text in zip(frame["id"], frame["text"]):
                try:
                    rows += [(key, *r, None) for r in client(text) if r[-1] is not None]
                except (OSError, ValueError) as e:
                    rows.append((key, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["id", "spot", "start", "stop", "title", "error"]).astype({"start": "Int32", "stop": "Int32"})

    return texts.select("id", "text").mapInPandas(work, schema)
