"""Writers; all go through Spark's own sinks, so they are as parallel as their input."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_lines(runs: DataFrame, most: int = 1000, doc: Column | None = None) -> DataFrame:
    w = Window.partitionBy("query_id", "method").orderBy(F.desc("score"), "doc_id")
    ranked = runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select("method", F.concat_ws(" ", "query_id", F.lit("Q0"), doc if doc is not None else F.col("doc_id"), F.col("rank").cast("string"), F.col("score").cast("string"), "method").alias("value"))


def write_run(runs: DataFrame, path: str, most: int = 1000) -> None:
    run_lines(runs, most).select("value").write.mode("overwrite").text(path)


def write_run_per_method(runs: DataFrame, path: str, most: int = 1000) -> None:
    run_lines(runs, most).write.mode("overwrite").partitionBy("method").text(path)


def write_entity_passage_run(runs: DataFrame, path: str) -> None:
    """Documents written as ``passage/entity``; both columns must be there."""
    run_lines(runs.withColumn("doc_id", F.concat_ws("/", "passage", "entity"))).select("value").write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str) -> None:
    qrels.select(F.concat_ws(" ", "query_id", F.lit("0"), "doc_id", F.col("rel").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_chunks(rows: DataFrame, path: str, rows_per_file: int) -> None:
    rows.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_tsv(rows: DataFrame, path: str, header: bool = True) -> None:
    rows.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_index(postings: DataFrame, path: str, shards: int = 8) -> None:
    """Postings range-partitioned and sorted by term, so a lookup reads few row groups."""
    postings.repartitionByRange(shards, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def merge_indexes(parts: list[DataFrame], path: str, shards: int = 8) -> None:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    write_index(out.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.max("len").alias("len")), path, shards)


def write_tables(tables: dict[str, DataFrame], database: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").saveAsTable(f"{database}.{name}")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    """``label id1 id2 text1 text2``, tab-separated without header; tabs in texts become blanks."""
    flat = [F.regexp_replace(c, r"[\t\r\n]", " ").alias(c) for c in ("text1", "text2")]
    write_tsv(rows.select("label", "id1", "id2", *flat), path, header=False)


def warc_records(docs: DataFrame, date: str) -> DataFrame:
    """One conversion record a document (id, text)."""
    body = F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: conversion\r\nWARC-Target-URI: "), F.col("id").cast("string"), F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/plain\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return docs.select(F.concat(head, body).alias("value"))


def write_warc(docs: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    warc_records(docs, date).write.mode("overwrite").option("lineSep", "\r\n\r\n").text(path)


def write_dot(edges: DataFrame, path: str) -> None:
    """Edge lines of a directed graph drawing."""
    edges.select(F.format_string('"%s" -> "%s" [weight=%s];', F.col("src").cast("string"), F.col("dst").cast("string"), F.col("weight").cast("string")).alias("value")).write.mode("overwrite").text(path)


def table_lines(rows: DataFrame, style: str = "plain") -> DataFrame:
    """Rows as lines of a plain, markdown or LaTeX table; nulls are a dash."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in rows.columns]
    line = {"plain": F.concat_ws("  ", *cells), "markdown": F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")), "latex": F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\"))}[style]
    return rows.select(line.alias("value"))


def write_provenance(folder: str, **facts: Any) -> None:
    """A sidecar beside a written table: where its rows come from."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "_provenance.json").write_text(json.dumps(facts, sort_keys=True, default=str))


def encode_cbor(value: Any) -> bytes:
    """One CBOR item (RFC 8949) with definite lengths."""

    def head(kind: int, n: int) -> bytes:
        if n < 24:
            return bytes([kind << 5 | n])
        for info, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
            if n < 1 << (8 * size):
                return bytes([kind << 5 | info]) + n.to_bytes(size, "big")
        raise ValueError("number too large for CBOR")

    if value is None or isinstance(value, bool):
        return bytes([{False: 0xF4, True: 0xF5, None: 0xF6}[value]])
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, float):
        return b"\xfb" + struct.pack(">d", value)
    if isinstance(value, bytes):
        return head(2, len(value)) + value
    if isinstance(value, str):
        raw = value.encode()
        return head(3, len(raw)) + raw
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(encode_cbor, value))
    if isinstance(value, dict):
        return head(5, len(value)) + b"".join(encode_cbor(k) + encode_cbor(v) for k, v in value.items())
    raise TypeError(f"no CBOR form for {type(value)}")


def write_cbor_list(rows: DataFrame, folder: str, header: Any) -> int:
    """One file a partition in a folder every worker sees: the header, then an indefinite list of the rows. Returns the row count."""

    def work(frames: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        out = Path(folder) / f"part-{TaskContext.get().partitionId():05d}.cbor"
        out.parent.mkdir(parents=True, exist_ok=True)
        n = 0
        with open(f"{out}.tmp", "wb") as f:
            f.write(encode_cbor(header) + b"\x9f")
            for frame in frames:
                for text in frame["value"]:
                    f.write(encode_cbor(json.loads(text)))
                    n += 1
            f.write(b"\xff")
        Path(f"{out}.tmp").rename(out)  # a repeated task writes the same file anew
        yield pd.DataFrame({"n": [n]})

    packed = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    return packed.mapInPandas(work, "n bigint").agg(F.sum("n")).first()[0] or 0
